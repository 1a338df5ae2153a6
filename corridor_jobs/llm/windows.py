"""Substring dedup on words: repeated windows of a fixed number of words, found by their Rabin-Karp hashes.

Every window of SIZE words is hashed. So that the shuffle does not carry a row per window, neighbouring windows travel as
one run: of the stretches of K words in a window the one with the least hash is its anchor, and windows next to each other
with one anchor make a run. Equal windows have the same anchor at the same place, so they can only meet in runs of one
anchor. Spark counts anchors; runs whose anchor occurs once hold no repeated window and go no further. Of the others,
equal runs are counted as one; where an anchor has several different runs, the windows of the first of each are counted
one by one. What occurs earlier is merged into maximal intervals of words to remove.

Anchors are told apart by 64 bits (more of them only mean more to compare), runs by 192 and windows by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, released, table, text_batches, whole, without, written
from .rolling import mixed
from .suffix_levels import NULL_ID, _named
from .word_arrays import STEP, Stretches, codes, grouped, table_of, words

SIZE, K = 20, 7
SEPARATORS = table_of(b" \t\n\v\f\r")
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POS = np.uint64((1 << 21) - 1)  # STEP words and a window more


class Words:
    """Words of some texts, with hashes of any stretch of them (of up to STEP words) under both bases."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.start, self.end = words(data, SEPARATORS)
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begin = np.cumsum(size) - size
        self.text = np.searchsorted(begin, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, begin)  # first word of each text
        self.codes = codes(data, self.start, self.end)
        self.data = data

    def slices(self, size: int) -> Iterator[tuple[int, Stretches, Stretches]]:
        """(first word, hashes) of slices of STEP words, each with size - 1 words of the next."""
        for lo in range(0, max(1, len(self.codes) - size + 1), STEP):
            part = self.codes[lo : lo + STEP + size - 1]
            yield lo, Stretches(part, BASES[0]), Stretches(mixed(part + np.uint64(1)), BASES[1])


def runs_of(texts: list[bytes], size: int = SIZE, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """For every run: index of its text, first window, number of windows, hash of its anchor, two hashes of the run."""
    w = Words(texts)
    for lo, one, two in w.slices(size):
        n = len(one.sums) - 1
        if n < size:
            return
        at = np.arange(n - size + 1)
        text = w.text[lo : lo + n]
        at = at[text[: n - size + 1] == text[size - 1 :]]
        gram = one.hashes(np.arange(n - k + 1), np.arange(k, n + 1))
        least = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
        span, want = 1, size - k + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if want > span:
            least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
        anchor = (least[at] & _POS).astype(np.int64)
        if not len(at):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, own = at[first], anchor[first]
        end, off = start + count + size - 1, (own - start).astype(np.uint64)
        yield text[start], start + lo - w.first[text[start]], count, gram[own], one.hashes(start, end) + off, two.hashes(start, end) + off


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def runs(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc, at, n, gram, h1, h2: the runs of every document (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(_texts(batches)):
            ids = np.array([i for i, _ in group], dtype=np.int64)
            for text, at, n, gram, h1, h2 in runs_of([t for _, t in group], size, k):
                columns = {"doc": ids[text], "at": at, "n": n.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(columns | {name: h.view(np.int64) for name, h in (("gram", gram), ("h1", h1), ("h2", h2))})

    return docs.select("_id", F.col("_text").cast("binary")).mapInArrow(run, "doc long, at long, n int, gram long, h1 long, h2 long")


def window_hashes(asked: DataFrame, size: int) -> DataFrame:
    """h1, h2, doc, at of the windows in the stretches (at, n) of asked (_id, _text, stretches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped((i, parts, t) for i, t, parts in _texts(batches)):
            w = Words([t for *_, t in group])
            text = np.concatenate([np.full(len(parts), j) for j, (_, parts, _) in enumerate(group)])
            at = np.array([p["at"] for _, parts, _ in group for p in parts], dtype=np.int64)
            n = np.array([p["n"] for _, parts, _ in group for p in parts], dtype=np.int64)
            ids = np.repeat(np.array([i for i, *_ in group], dtype=np.int64)[text], n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n) + inner
            place = at + w.first[np.repeat(text, n)]
            for lo, one, two in w.slices(size):
                here = (place >= lo) & (place < lo + STEP)
                s = place[here] - lo
                yield pa.RecordBatch.from_pydict({"h1": one.hashes(s, s + size).view(np.int64), "h2": two.hashes(s, s + size).view(np.int64), "doc": ids[here], "at": at[here]})

    return asked.select("_id", F.col("_text").cast("binary"), "stretches").mapInArrow(run, "h1 long, h2 long, doc long, at long")


def repeated(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc, start, end: stretches of words of the documents (_id, _text) covered by windows that also start earlier."""
    spark = docs.sparkSession
    every = runs(docs, size, k)
    anchors = written(every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"))
    released(spark)
    shared = written(every.join(anchors, "gram"))
    discard(anchors)
    released(spark)
    place = F.struct("doc", "at")
    firsts = written(shared.groupBy("gram", "h1", "h2").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c")))
    later = shared.join(firsts.filter("c > 1").select("gram", "h1", "h2", "first"), ["gram", "h1", "h2"]).filter(place != F.col("first"))
    covered = written(later.select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") + size - 1).alias("end")))
    discard(shared)
    several = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
    opened = firsts.join(several, "gram").select(F.col("first.doc").alias("_id"), F.struct(F.col("first.at").alias("at"), "n").alias("s"))
    asked = docs.join(opened.groupBy("_id").agg(F.collect_list("s").alias("stretches")), "_id")
    single = written(window_hashes(asked, size))
    once = single.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    again = single.join(once, ["h1", "h2"]).filter(place != F.col("first"))
    out = written(covered.unionByName(again.select("doc", F.col("at").alias("start"), (F.col("at") + size).alias("end"))))
    discard(firsts, covered, single)
    released(spark)
    return out


def _kept(data: bytes, runs: list[dict]) -> tuple[int, bytes, list[int], list[int]]:
    """Number of words, what is kept of them, and start and end of the maximal removed runs."""
    array = np.frombuffer(data, dtype=np.uint8)
    start, end = words(array, SEPARATORS)
    step = np.zeros(len(start) + 1, dtype=np.int64)
    for r in runs or ():
        step[min(r["start"], len(start))] += 1
        step[min(r["end"], len(start))] -= 1
    gone = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
    keep = np.flatnonzero(~gone)
    return len(start), b" ".join(data[a:b] for a, b in zip(start[keep], end[keep], strict=True)), edge[0::2].tolist(), edge[1::2].tolist()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K, kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, starts, ends (of the maximal runs of removed words), and kept if asked for.

    Words are runs of anything but blanks (0x20, 0x09 to 0x0D). A word goes if a window of size words that covers it also
    starts earlier: in a smaller doc_id or further left. Windows are judged on the input and do not cross documents; kept
    words are joined by one space. Null texts count as empty; texts of fewer words than a window stay whole. A text that
    equals an earlier one goes whole and is not searched. doc_id is a long, a null one the least; rows that share an id
    but not the text follow one another by a hash of the text, rows that repeat both share what they keep. Long texts are
    hashed in slices. Extra columns are ignored. One row per input row; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), whole(text_col).alias("_text"))
    src, copies, names = _named(src)
    found = repeated(without(src, copies, "_id"), size, k)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit((1 << 62)).cast("long").alias("end")))
    cuts = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    long_copies = src.join(copies, "_id", "left_semi").filter(F.regexp_count("_text", F.lit(WORD)) >= size).select("_id").distinct()
    cuts = cuts.unionByName(long_copies.select(F.col("_id").alias("doc"), all_words.alias("runs")))

    fields = {"_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
    fields |= {"kept": pa.string()} if kept_text else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, data, spans in _texts([batch]):
                n, kept, starts, ends = _kept(data, spans)
                row = (i, n, sum(ends) - sum(starts), hashlib.sha256(kept).hexdigest(), starts, ends)
                made.append((*row, kept.decode()) if kept_text else row)
            columns = zip(*made, strict=True) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))

    schema = "_id long, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>" + ", kept string" * kept_text
    every = src.join(cuts.withColumnRenamed("doc", "_id"), "_id", "left").select("_id", F.col("_text").cast("binary"), "runs")
    cut = every.mapInArrow(run, schema)
    if names is not None:
        cut = cut.join(names, "_id").withColumn("_id", F.col("_doc")).drop("_doc")
    return cut.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), *cut.columns[1:])


def op11_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + {SIZE - 1}], ' ') AS body
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SIZE - 2})) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS i FROM later),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
