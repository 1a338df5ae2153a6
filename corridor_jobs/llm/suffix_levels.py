"""Repeated byte strings across documents, by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes contains an anchor: the least K-byte gram by hash among its LENGTH - K + 1 grams, the leftmost
of equals. Equal strings have the same anchor at the same place, so it is enough to index the suffixes that start at
anchors, about one byte in thirty. A run of neighbouring strings with one anchor is one segment.

The array of a batch of documents holds each distinct segment once, at its first place, bucketed and sorted by the hash
of the first K bytes of its suffix. It is merge-scanned against every level of the index, bucket by bucket: suffixes that
share K bytes meet. A segment met before, whole, is a match from end to end; distinct segments that share a suffix's
first bytes are compared string by string from their bytes. Levels of equal size are merged when the next batch arrives,
so a suffix is rewritten a logarithmic number of times. The family stays in its folder and takes further batches.

Segments are told apart by 64 bits among those that share a 64-bit gram; strings by 64 bits among those of one gram.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, released, shared_dir, table, text_batches, whole, without, written
from .rolling import Rolling

LENGTH, K = 100, 36
BATCHES = 4
#: Segments that share a gram are compared in one place up to so many; those of more common grams string by string.
CROWD = 2_000
GROUP_BYTES, PIECE_BYTES = 1 << 20, 4 << 20
_POS = np.uint64((1 << 24) - 1)
NULL_ID = -(1 << 63)  # a null doc_id counts as the least


def segments_of(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For every segment: index of its text, first string's offset, number of strings, gram hash, segment hash.

    All texts together stay under 2 ** 24 bytes.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    strings = np.maximum(size - length + 1, 0)
    total = int(strings.sum())
    if not total:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    roll = Rolling(data)
    gram = roll.windows(k)
    least = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    span, want = 1, length - k + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if want > span:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    text = np.repeat(np.arange(len(texts)), strings)
    at = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings) + begin[text]
    anchor = (least[at] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, total))
    start, own = at[first], anchor[first]
    whole_segment = roll.hashes(start, start + count + length - 1) + (own - start).astype(np.uint64)
    return text[first], start - begin[text[first]], count, gram[own], whole_segment


def _grouped(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """ids, offsets and bytes in groups of about GROUP_BYTES; a long text comes in pieces that overlap by LENGTH - 1."""
    held: tuple[list, list[int], list[bytes]] = ([], [], [])
    size = 0
    for i, data in texts:
        for lo in range(0, max(1, len(data) - LENGTH + 1), PIECE_BYTES):
            piece = data[lo : lo + PIECE_BYTES + LENGTH - 1]
            held[0].append(i)
            held[1].append(lo)
            held[2].append(piece)
            size += len(piece)
            if size >= GROUP_BYTES:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def rows_of(texts: Iterator[tuple[int, bytes]]) -> Iterator[dict[str, np.ndarray]]:
    """The segments of texts by column; again says that the same text has the same segment further left."""
    seen, last = np.zeros(0, dtype=np.uint64), None  # of a text that goes on in the next group
    for ids, offsets, parts in _grouped(texts):
        text, at, n, gram, segment = segments_of(parts)
        row = np.cumsum([k == 0 or offsets[k] == 0 for k in range(len(ids))])  # pieces of one text count as one
        owner = row[text]
        order = np.lexsort((np.arange(len(segment)), segment, owner))
        again = np.zeros(len(segment), dtype=bool)
        again[order[1:]] = (segment[order[1:]] == segment[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        if offsets[0] and last == ids[0]:
            begun = owner == row[0]
            again |= begun & np.isin(segment, seen)
        else:
            seen = seen[:0]
        tail = segment[owner == row[-1]]
        seen, last = np.union1d(seen, tail) if row[-1] == row[0] else np.unique(tail), ids[-1]
        yield {"doc": np.array(ids, dtype=np.int64)[text], "at": np.array(offsets, dtype=np.int64)[text] + at, "n": n.astype(np.int32), "gram": gram.view(np.int64), "segment": segment.view(np.int64), "again": again}


def entries(docs: DataFrame) -> DataFrame:
    """doc, at, n, gram, segment, again: the segments of every document (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                for i, t in zip(b.column(0), b.column(1), strict=True):
                    yield i.as_py(), t.as_py()

        for made in rows_of(texts()):
            yield pa.RecordBatch.from_pydict(made)

    return docs.select("_id", F.col("_text").cast("binary")).mapInArrow(run, "doc long, at long, n int, gram long, segment long, again boolean")


ARRAY = "gram LONG, segment LONG, doc LONG, at LONG, n INT, copies LONG"


class Levels:
    """The index: a bucketed, sorted table of distinct segments per level, with its size as a power of two of batches.

    root is a folder that all machines share. What an earlier run left there is opened: root/manifest lists the levels
    of each state, the last of which counts, so a batch that fails half-way leaves the state before it.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 0):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[tuple[int, str]] = []
        self.state = 0
        try:
            states = spark.read.schema("state LONG, place INT, power INT, name STRING, buckets INT").parquet(f"{self.root}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.state = max(r.state for r in states)
        for r in sorted((r for r in states if r.state == self.state), key=lambda r: r.place):
            self.buckets = r.buckets
            self.tables.append((r.power, r.name))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} ({ARRAY}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {r.buckets} BUCKETS LOCATION '{self.root}/{r.name}'")

    def _stored(self, rows: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        columns = ["gram", "segment", "doc", "at", "n", "copies"]
        rows.select(columns).write.bucketBy(self.buckets, "gram").sortBy("gram").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _merged(self) -> list[str]:
        """Merges the last two levels while they are of one size; returns the names of the tables merged."""
        old: list[str] = []
        while len(self.tables) > 1 and self.tables[-1][0] == self.tables[-2][0]:
            (power, a), (_, b) = self.tables.pop(), self.tables.pop()
            # One plain scan of both folders: Spark 4.1 takes a union of bucketed scans for bucketed, and groups within its parts.
            both = self.spark.read.schema(ARRAY).parquet(f"{self.root}/{a}", f"{self.root}/{b}").repartition(self.buckets, "gram")
            both = both.groupBy("gram", "segment").agg(F.min_by("at", "doc").alias("at"), F.min("doc").alias("doc"), F.max("n").alias("n"), F.sum("copies").alias("copies"))
            self.tables.append((power + 1, self._stored(both)))
            old += [a, b]
        return old

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a batch of documents (_id, _text), all later than those in the index.

        Returns the stretches (doc, start, end) of the batch that whole segments met before cover, and the segments
        (gram, segment, doc, at, n) of the batch and the index that share a gram with another and are to be compared.
        """
        old = self._merged()
        raw = written(entries(docs))
        own = raw.filter("NOT again")
        firsts = own.groupBy("gram", "segment").agg(F.min("doc").alias("doc"), F.min_by("at", "doc").alias("at"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        name = self._stored(firsts.repartition(self.buckets, "gram"))
        batch = self.spark.table(name)
        # The merge scan: what the levels have under the grams of the batch, then what the batch has under those.
        met = [written(self.spark.table(level).join(batch.select("gram"), "gram", "left_semi")) for _, level in self.tables]
        several = batch.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram")
        if not met:
            known = batch.limit(0)
            shared = several
        else:
            hits = self.spark.read.schema(met[0].schema).parquet(*(m.written_path for m in met))
            known = written(hits.groupBy("gram", "segment").agg(F.min_by("at", "doc").alias("at"), F.min("doc").alias("doc"), F.max("n").alias("n"), F.sum("copies").alias("copies")))
            shared = several.unionByName(known.select("gram")).distinct()
        fresh = written(batch.join(shared, "gram", "left_semi"))
        inside = known.select("gram", "segment", F.lit(True).alias("_known"))
        keep = batch.filter("copies > 1").select("gram", "segment", "doc").unionByName(known.select("gram", "segment", F.lit(None).cast("long").alias("doc")))
        keep = keep.groupBy("gram", "segment").agg((F.count(F.lit(1)) > F.count("doc")).alias("_known"), F.max("doc").alias("_first"))
        covered = own.join(keep, ["gram", "segment"]).filter("_known OR doc <> _first").select("doc", "at", "n")
        covered = covered.unionByName(raw.filter("again").select("doc", "at", "n"))
        gone = written(covered.select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") + LENGTH - 1).alias("end")))
        new = fresh.join(inside, ["gram", "segment"], "left_anti")
        every = new.select("gram", "segment", "doc", "at", "n").unionByName(known.select("gram", "segment", "doc", "at", "n"))
        apart = every.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram")
        open_ = written(every.join(apart, "gram", "left_semi"))
        self.tables.append((0, name))
        self._commit(old)
        discard(raw, fresh, *met, *([known] if met else []))
        released(self.spark)
        return gone, open_

    def _commit(self, old: list[str]) -> None:
        self.state += 1
        rows = [(self.state, k, power, name, self.buckets) for k, (power, name) in enumerate(self.tables)]
        self.spark.createDataFrame(rows, "state LONG, place INT, power INT, name STRING, buckets INT").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self._drop(*old)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Deletes the index."""
        self._drop(*(name for _, name in self.tables), "manifest")
        self.tables = []


def repeated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, start, end: stretches of bytes of _id, _text that hold a string of LENGTH bytes which also starts earlier.

    The documents go through an index of their own in batches by _id.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)] or [1.0]).alias("q")).first().q
    edges = [None, *sorted(set(cuts or [])), None] if batches > 1 else [None, None]
    index = Levels(spark)
    gone, open_ = [], []
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        part = docs
        if lo is not None:
            part = part.filter(F.col("_id") >= lo)
        if hi is not None:
            part = part.filter(F.col("_id") < hi)
        a, b = index.add(part)
        gone.append(a)
        open_.append(b)
    index.close()
    return _all(gone).unionByName(compared(docs, _all(open_)))


def added(index: Levels, docs: DataFrame, earlier: DataFrame) -> DataFrame:
    """doc, start, end of what a further batch of documents (_id, _text) repeats, of itself or of the documents in the
    index (earlier, those ids all smaller), which it joins."""
    gone, open_ = index.add(docs)
    found = gone.unionByName(compared(docs.unionByName(earlier), open_))
    return found.join(docs.select(F.col("_id").alias("doc")).distinct(), "doc", "left_semi")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compared(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """doc, start, end: of the strings in segments that share a gram, those that also start earlier in another."""
    spark = docs.sparkSession
    each = written(open_.groupBy("gram", "segment").agg(F.min_by("at", "doc").alias("at"), F.min("doc").alias("doc"), F.max("n").alias("n")))
    crowds = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWD).select("gram", F.lit(True).alias("crowded"))
    asked = each.join(crowds, "gram", "left").groupBy("doc").agg(F.collect_list(F.struct("at", "n", "gram", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("runs"))
    bytes_of = lambda r: F.substring(F.col("_data"), (r["at"] + 1).cast("int"), r["n"] + LENGTH - 1)
    cut = F.transform("runs", lambda r: F.struct(r["gram"].alias("gram"), r["crowded"].alias("crowded"), r["at"].alias("at"), r["n"].alias("n"), bytes_of(r).alias("bytes")))
    texts = _with_text(docs, asked).withColumn("_data", F.col("_text").cast("binary"))
    with_bytes = written(texts.select(F.col("_id").alias("doc"), F.explode(cut).alias("r")).select("doc", "r.*"))
    discard(each)
    released(spark)
    spread = with_bytes.filter("NOT crowded").select("gram", "doc", "at", "n", "bytes")
    near = spread.repartition("gram").sortWithinPartitions("gram").mapInPandas(_compared, "doc long, start long, end long")
    strings = with_bytes.filter("crowded").mapInPandas(_strings, "gram long, hash long, doc long, at long")
    place = F.struct("doc", "at")
    once = strings.groupBy("gram", "hash").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram", "hash", "f")
    again = strings.join(once, ["gram", "hash"]).filter(place != F.col("f"))
    return near.unionByName(again.select("doc", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")))


def _with_text(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """per_doc (doc, one row each) with _text."""
    return docs.select("_id", "_text").join(per_doc.withColumnRenamed("doc", "_id"), "_id")


def _hashed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every string of some segments, with its document and offset."""
    n = pdf["n"].to_numpy(np.int64)
    size = pdf["bytes"].map(len).to_numpy(np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + inner
    h = Rolling(np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8)).hashes(start, start + LENGTH)
    return h, np.repeat(pdf["doc"].to_numpy(np.int64), n), np.repeat(pdf["at"].to_numpy(np.int64), n) + inner


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000]
            h, doc, at = _hashed(part)
            gram = np.repeat(part["gram"].to_numpy(), part["n"].to_numpy())
            yield pd.DataFrame({"gram": gram, "hash": h.view(np.int64), "doc": doc, "at": at})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of gram -> stretches of later strings. A gram's segments may run on into the next batch."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        gram = pdf["gram"].to_numpy()
        cut = int(np.searchsorted(gram, gram[-1], side="left")) if len(gram) else 0
        held = pdf.iloc[cut:]
        yield from _later(pdf.iloc[:cut])
    if held is not None:
        yield from _later(held)


def _later(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    gram = pdf["gram"].to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1, [len(gram)]]) if len(gram) else np.zeros(1, dtype=int)
    lo = 0
    while lo < len(gram):  # whole grams, some thousands of segments at a time
        hi = int(edges[min(np.searchsorted(edges, lo + 4000, side="left"), len(edges) - 1)])
        part = pdf.iloc[lo:hi]
        h, doc, at = _hashed(part)
        order = np.lexsort((at, doc, h))
        h, doc, at = h[order], doc[order], at[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        owner = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        again = (doc != doc[owner]) | (at != at[owner])
        doc, at = doc[again], at[again]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        if len(doc):
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]))
            last = np.append(new[1:], len(doc)) - 1
            yield pd.DataFrame({"doc": doc[new], "start": at[new], "end": at[last] + LENGTH})
        lo = hi


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """_id, _text of the rows, in which every _id has one text; the ids (_id) of rows whose text stands whole in an
    earlier one; and the doc_id of each _id where ids had to be given anew, which is where a doc_id has two texts."""
    key = [F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(7), F.col("_text")).alias("h2")]
    keys = docs.select("_id", *key).distinct()
    if keys.groupBy("_id").count().filter("count > 1").isEmpty():
        keys, names = written(keys), None
    else:
        keys = written(keys.orderBy("_id", "h1", "h2").withColumnRenamed("_id", "_doc").withColumn("_id", F.monotonically_increasing_id()))
        names = keys.select("_id", "_doc")
        docs = docs.withColumnRenamed("_id", "_doc").select("_doc", "_text", *key).join(keys, ["_doc", "h1", "h2"]).select("_id", "_text")
    first = keys.groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return docs, written(keys.join(first, ["h1", "h2"]).filter("_id <> _first").select("_id")), names


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (of removed runs), and kept (bytes) if asked for.

    Every byte of a text (UTF-8; null is empty) covered by a LENGTH-byte string that also starts earlier, in a smaller
    doc_id or further left, is removed. Strings are judged on the input and never cross documents. doc_id is a long; a
    null one counts as the least. Rows that share an id but not the text follow one another by a hash of the text; rows
    that repeat both are one place, and share what they keep. Texts shorter than LENGTH stay whole; very long ones are
    read in overlapping pieces. A text that equals an earlier one is removed whole, and indexed once. Extra columns are
    ignored. One row per input row; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), whole(text_col).alias("_text"))
    src, copies, names = _named(src)
    runs = repeated(without(src, copies, "_id"), batches).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit((1 << 31) - 1).cast("long").alias("end")))
    runs = written(runs.unionByName(copies.select(F.col("_id").alias("doc"), all_of.alias("runs"))))
    released(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            edge = runs.offsets.to_numpy()
            start, end = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            made: list[tuple] = [(i.as_py(), *_cut(t.as_py(), start[a:b], end[a:b])) for i, t, a, b in zip(batch.column(0), batch.column(1), edge, edge[1:], strict=False)]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, fields.values(), strict=False)], names=list(fields))

    longs = pa.list_(pa.int64())
    fields = {"_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "starts": longs, "ends": longs}
    fields |= {"kept": pa.binary()} if kept_text else {}
    kept = ", kept binary" if kept_text else ""
    schema = f"_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>{kept}"
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    every = src.select("_id", F.col("_text").cast("binary")).join(runs.withColumnRenamed("doc", "_id"), "_id", "left")
    cut = every.select("_id", "_text", F.coalesce("runs", none)).mapInArrow(run, schema)
    if names is not None:
        cut = cut.join(names, "_id").withColumn("_id", F.col("_doc")).drop("_doc")
    return cut.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), *cut.columns[1:])


def _cut(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    """What the bytes come to without the stretches; of a text under LENGTH nothing goes."""
    if len(data) < LENGTH or not len(start):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), [], [], data
    step = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(end, len(data)), -1)
    gone = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
    return len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist(), kept


def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
