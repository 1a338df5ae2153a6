"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded). The binary Golay code [23, 12, 7] is
perfect: every 23-bit word lies within 3 bits of exactly one of 4,096 codewords. A word's keys are the indices of the
codewords nearest to it and to its 23 neighbours at one bit; there are 1 or 6. Of two words that differ in at most one
bit, each has the other's own index among its keys.

Three wrong bits fall on the segments as 3-0-0, 2-1-0 or 1-1-1, or fewer. So either one segment is equal and another has
at most one wrong bit (six ordered pairs of segments: exact bits and an index), or each segment has at most one (three
indices). An entry is stored under its own indices and looked up under all its keys; pairs that meet are verified.

A stored list longer than CROWD is not paired with its visitors. Fingerprints that visit such a list are linked exactly
in another way: all that have a word within one bit of them in common differ by 2 at most and are tied to one of them;
what then still lies in one list but in different components is looked up by words within two bits of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import checkpointed, released, semi, table, text_batches, whole, written
from .components import components

BITS = 3
CROWD = 64
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the Golay code
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SEED = 42


@lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """For each 23-bit word the index of its nearest codeword: codewords by polynomial product, then all errors up to 3."""
    index = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, dtype=np.int64)
    for i in range(12):
        code ^= np.where(index >> i & 1, GENERATOR << i, 0)
    out = np.zeros(1 << 23, dtype=np.int16)
    bit = [1 << i for i in range(23)]
    errors = [0, *bit, *(a | b for i, a in enumerate(bit) for b in bit[:i])]
    errors += [a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]]
    for e in errors:
        out[code ^ e] = index
    return out


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash over the XXH64 of every shingle of words, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not w:
        return 0
    n = min(words, len(w))
    h = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(n)))], dtype=np.uint64)  # noqa: B905
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; null counts as empty."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["_text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    return src.mapInPandas(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long")


def _keys(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each key family: own key (n), and keys looked up (n, k) where repeats are -1."""
    near = golay()
    x = fp.view(np.uint64)
    seg = [((x >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    wide = []
    for s in seg:
        k = np.sort(near[s[:, None] ^ flips].astype(np.int64), axis=1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
        k = -np.sort(-k, axis=1)[:, :6]  # at most six differ
        wide.append(k)
    own = [near[s].astype(np.int64) for s in seg]
    stored, sought, family = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                head = (np.int64(family) << 58) | (seg[i] << 12)
                stored.append(head | own[j])
                sought.append(np.where(wide[j] < 0, -1, head[:, None] | wide[j]))
                family += 1
    head = np.int64(family) << 58
    stored.append(head | own[0] << 24 | own[1] << 12 | own[2])
    a, b, c = wide[0][:, :, None, None], wide[1][:, None, :, None], wide[2][:, None, None, :]
    triple = np.where((a < 0) | (b < 0) | (c < 0), -1, head | a << 24 | b << 12 | c)
    sought.append(triple.reshape(len(fp), -1))
    return stored, sought


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy()
        for k in _keys(fp)[0]:
            yield pd.DataFrame({"key": k, "fp": fp})


def _sought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 2000):
            fp = pdf["fp"].to_numpy()[lo : lo + 2000]
            for k in _keys(fp)[1]:
                keep = k >= 0
                yield pd.DataFrame({"key": k[keep], "fp": np.repeat(fp, keep.sum(axis=1))})


def _around(radius: int):
    """Words within so many bits of each fingerprint, with the number of bits."""
    one = [1 << i for i in range(64)]
    flips = np.array([0, *one] if radius == 1 else [a | b for i, a in enumerate(one) for b in one[:i]], dtype=np.uint64)
    bits = np.array([0] + [1] * 64 if radius == 1 else [2] * len(flips), dtype=np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                fp = pdf["fp"].to_numpy()[lo : lo + 500]
                w = fp.view(np.uint64)[:, None] ^ flips
                yield pd.DataFrame({"word": w.ravel().view(np.int64), "fp": np.repeat(fp, len(flips)), "bits": np.tile(bits, len(fp))})

    return run


def links(fps: DataFrame) -> DataFrame:
    """Edges u, v whose components are those of all pairs of fingerprints that differ in 3 bits or fewer.

    fps has each fingerprint once. Every edge is such a pair. Every such pair is an edge or joined by a path of edges.
    """
    stored = checkpointed(fps.mapInPandas(_stored, "key long, fp long"))
    crowded = checkpointed(stored.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    sought = fps.mapInPandas(_sought, "key long, fp long").withColumnRenamed("fp", "u")
    calm = stored.withColumnRenamed("fp", "v")
    if some := crowded.limit(1).count():
        calm = calm.join(crowded, "key", "left_anti")
    met = sought.join(calm, "key").filter("u <> v AND bit_count(u ^ v) <= 3")
    edges = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if not some:
        return edges
    visits = checkpointed(semi(fps.mapInPandas(_sought, "key long, fp long"), crowded, ["key"]))
    dense = checkpointed(visits.select("fp").distinct())
    return edges.unionByName(_dense_links(dense, visits))


def _dense_links(dense: DataFrame, visits: DataFrame) -> DataFrame:
    """Edges among the visitors of crowded lists, about linear in their number."""
    words = checkpointed(dense.mapInPandas(_around(1), "word long, fp long, bits int").select("word", "fp"))
    centre = words.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n"))
    close = checkpointed(words.join(centre.filter("n > 1"), "word").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct())
    label = components(close)
    placed = visits.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    size = placed.groupBy("key", "label").count()
    most = size.groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    apart = placed.join(most.select("key", F.col("m.label").alias("main")), "key").filter("label <> main").select("fp").distinct()
    far = checkpointed(apart.mapInPandas(_around(2), "word long, fp long, bits int").select("word", F.col("fp").alias("u")))
    third = far.join(centre, "word").filter("u <> v").select("u", "v")
    out = close.unionByName(third).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return out.distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (least doc_id reachable over links).

    Equal fingerprints are one node, counted once however many rows share it. Null text counts as empty; texts without
    words have fingerprint 0 and link like any other. A row with a null doc_id gets its component's least id. Extra
    columns are ignored, an empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, words))
    released(docs.sparkSession)
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(links(fps.select("fp")))
    tagged = fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = tagged.groupBy("label").agg(F.min("first").alias("component_id"))
    mapped = tagged.join(least, "label").select("fp", "component_id")
    return rows.join(mapped, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close_pairs(texts: DataFrame) -> DataFrame:
    """u, v: nodes of texts (node, _text) that their fingerprints tie together. Of equal fingerprints each node is paired
    with the least one, and the least ones of two fingerprints are paired where these link."""
    rows = written(fingerprints(texts, "node", "_text").withColumnRenamed("doc_id", "node"))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("node").alias("first")))
    equal = rows.join(fps, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    met = links(fps.select("fp")).join(fps.toDF("u", "_u"), "u").join(fps.toDF("v", "_v"), "v")
    return equal.unionByName(met.select(F.col("_u").alias("u"), F.col("_v").alias("v"))).distinct()


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component of near copies (see near_copies) the one with the least doc_id. Links of
    fingerprints come first, each verified on the texts' shingles."""
    return near_copies.drop_near(docs, close_pairs)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
