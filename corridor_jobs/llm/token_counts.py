"""Token totals by source, language and tokenizer version, kept by signed changes in idempotent batches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, table, whole, written

#: What counts as a token, by tokenizer version.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]",
}
KEYS = ["source", "lang", "version"]


def n_tokens(text: Column, version: str) -> Column:
    """Tokens of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def inserted(counts: DataFrame) -> DataFrame:
    """Changes for new documents (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take documents back; tokens is what they last counted."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes from tokens_before to tokens of the same document."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col("tokens_before")).alias("tokens"))


@dataclass
class Rollup:
    """Totals as a table that each batch replaces.

    A state is a folder of two tables, the totals and the ids of the batches in them, and a file state-<n> that names the
    folder; the largest n counts. A commit adds its batch to the last state, writes a folder of its own, and puts its file
    in place by a rename that fails if the file is there: either the totals and the list both have the batch, or neither.
    Who loses that race starts again from the state that won. A batch in the list is left alone, whatever is offered under
    its id: a job may be run again after any failure. Reading opens one table, however many batches there were; the folder
    of the state before stays for those who still read it, older ones go.
    """

    spark: SparkSession
    root: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        if not self._fs().exists(self._path()):
            return []
        names = (str(s.getPath().getName()) for s in self._fs().listStatus(self._path()))
        return sorted(int(n[6:]) for n in names if n.startswith("state-"))

    def _folder(self, state: int) -> str:
        """The folder that a state names."""
        file = self._fs().open(self._path(f"state-{state}"))
        try:
            return str(self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(file)).readLine())
        finally:
            file.close()

    def _tables(self, states: list[int]) -> tuple[DataFrame, DataFrame]:
        """Totals (KEYS, docs, tokens) and batches (batch) of the last state."""
        schema = "source string, lang string, version string, docs long, tokens long"
        if not states:
            return self.spark.createDataFrame([], schema), self.spark.createDataFrame([], "batch string")
        at = f"{self.root}/{self._folder(states[-1])}"
        return self.spark.read.schema(schema).parquet(f"{at}/totals"), self.spark.read.schema("batch string").parquet(f"{at}/batches")

    def _put(self, folder: str, state: int) -> bool:
        """The file of a state, which names its folder; False if there is one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        written_to = self._path(f"{folder}/name")
        out = self._fs().create(written_to)
        out.write(bytearray(folder.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(written_to, self._path(f"state-{state}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        return True

    def committed(self, batch: str) -> bool:
        return not self._tables(self._states())[1].filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if it was there."""
        sums = None
        while True:
            states = self._states()
            totals, batches = self._tables(states)
            if not batches.filter(F.col("batch") == batch).isEmpty():
                return False
            if sums is None:  # once, however often the race is lost
                sums = written(changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
            folder = f"folder-{uuid.uuid4().hex}"
            both = totals.unionByName(sums).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            both.filter("docs <> 0 OR tokens <> 0").write.parquet(f"{self.root}/{folder}/totals")
            batches.unionByName(self.spark.createDataFrame([(batch,)], "batch string")).coalesce(1).write.parquet(f"{self.root}/{folder}/batches")
            if self._put(folder, (states[-1] if states else 0) + 1):
                discard(sums)
                for old in states[:-1]:
                    self._fs().delete(self._path(self._folder(old)), True)
                    self._fs().delete(self._path(f"state-{old}"), True)
                return True
            self._fs().delete(self._path(folder), True)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; keys whose documents are all taken back are left out. No rows before
        the first batch."""
        return self._tables(self._states())[0].select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, copy (hash of the text), and token counts: first, redacted (numbers taken out), second."""
    text = whole("text")
    return docs.select(
        "doc_id",
        "source",
        "lang",
        F.sha2(text.cast("binary"), 256).alias("copy"),
        n_tokens(text, "words-1").alias("first"),
        n_tokens(F.regexp_replace(text, "[0-9]+", ""), "words-1").alias("redacted"),
        n_tokens(text, "words-2").alias("second"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them offered twice: all documents counted by words-1; their
    counts by words-1 revised once numbers are redacted; all counted by words-2; copies (the same text under a lesser
    doc_id) deleted from both versions. Null source and lang are keys of their own."""
    counts = written(counted(table(spark, sf_dir, "documents")))
    of = lambda version, column, *more: counts.select("source", "lang", F.lit(version).alias("version"), F.col(column).alias("tokens"), *more)
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1", inserted(of("words-1", "first")))
    redacted = revised(of("words-1", "redacted", F.col("first").alias("tokens_before")))
    rollup.commit("2", redacted)
    rollup.commit("3", inserted(of("words-2", "second")))
    rollup.commit("2", redacted)  # offered again, as after a failure: no effect
    kept = counts.groupBy("copy").agg(F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = counts.join(kept, "copy").filter("doc_id < _last")
    pair = lambda version, column: F.struct(F.lit(version).alias("version"), F.col(column).alias("tokens"))
    gone = copies.select("source", "lang", F.explode(F.array(pair("words-1", "redacted"), pair("words-2", "second"))).alias("v"))
    rollup.commit("4", deleted(gone.select("source", "lang", "v.version", "v.tokens")))
    return rollup.totals()


SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS body,
         doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept
  FROM documents
), c AS (
  SELECT source, lang,
         len(regexp_extract_all(regexp_replace(body, '[0-9]+', '', 'g'), '[^\x20\x09-\x0D]+')) AS one,
         len(regexp_extract_all(body, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS two
  FROM d WHERE kept
)
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs, CAST(sum(one) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*), CAST(sum(two) AS BIGINT) FROM c GROUP BY source, lang
"""
