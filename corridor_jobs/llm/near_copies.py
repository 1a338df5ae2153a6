"""Near copies of whole texts: Jaccard similarity of five-word shingles, 0.8 or more.

Links of SimHash fingerprints (see simhash.close_pairs) come first, are verified on the sets, and settle the close copies.
At 0.8 fingerprints differ in about 10 of 64 bits, too many for exact keys: candidates among texts that the fingerprints
leave apart come from MinHash, 32 bands of 5 minima. A pair of similarity s meets in a band with probability s ** 5, so one of exactly
0.8 is missed with probability (1 - 0.8 ** 5) ** 32 = 3e-6, a closer one less often. Every edge is verified on the sets
themselves.

The members of a bucket are first verified against its least one. Of a bucket that then still lies in several components,
the pairs across components are found exactly by a prefix join: shingles are ordered from the rarest, and two sets that
are similar enough share one among the first fifth of each, early enough that what follows can still make up 0.8. The
bounds are part of the join's condition, so the rows it makes do not grow with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, discard, released, text_batches, whole, written
from .components import components

WORDS = 5
BANDS, ROWS = 32, 5
SEED = 42
#: Rows that a worker turns into one output batch.
ROWS_AT_ONCE = 512


@lru_cache(maxsize=16)
def shingles(text: str) -> np.ndarray:
    """The sorted distinct XXH64 of every shingle of WORDS words (of the whole text if it has fewer); 0 without words."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not w:
        return np.zeros(1, dtype=np.uint64)
    n = min(WORDS, len(w))
    return np.unique(np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(n)))], dtype=np.uint64))  # noqa: B905


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the shared part is at least 4/5 of the union."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """A mask and an odd factor for each minimum."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minima(s: np.ndarray) -> np.ndarray:
    mask, factor = _orders()
    parts = [((s[lo : lo + 256, None] ^ mask) * factor).min(axis=0) for lo in range(0, len(s), 256)]
    return np.min(parts, axis=0)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            keys: list[int] = []
            sizes: list[int] = []
            for text in part.column(1):
                s = shingles(text.as_py())
                sizes.append(len(s))
                keys += [xxh64_intdigest(m.tobytes(), band) for band, m in enumerate(minima(s).reshape(BANDS, ROWS))]
            out = {"key": np.array(keys, dtype=np.uint64).view(np.int64), "node": np.repeat(part.column(0).to_numpy(), BANDS)}
            yield pa.RecordBatch.from_pydict(out | {"n": np.repeat(np.array(sizes, dtype=np.int64), BANDS)})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [near(shingles(a.as_py()), shingles(b.as_py())) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column(0), batch.column(1), strict=True):
            s = shingles(text.as_py())
            yield pa.RecordBatch.from_pydict({"node": np.full(len(s), node.as_py(), dtype=np.int64), "n": np.full(len(s), len(s), dtype=np.int64), "shingle": s.view(np.int64)})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs u, v of nodes whose texts are near."""
    a, b = texts.toDF("u", "_a"), texts.toDF("v", "_b")
    return pairs.join(b, "v").join(a, "u").select("u", "v", "_a", "_b").mapInArrow(_near, "u long, v long")


def prefix_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """u, v: among the nodes of labels (node, label), a superset of the near pairs with different labels."""
    each = written(texts.join(labels, "node").select("node", "_text").mapInArrow(_exploded, "node long, n long, shingle long"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("node").orderBy("often", "shingle")
    placed = each.join(often, "shingle").withColumn("at", F.row_number().over(order) - 1)
    first = placed.filter("often > 1 AND at <= n - ceil(4 * n / 5)").join(labels, "node")
    first = written(first.select("shingle", "node", "n", "at", "label"))
    other = first.toDF("shingle", "_node", "_n", "_at", "_label")
    fits = "node < _node AND label <> _label AND 9 * (1 + least(n - at - 1, _n - _at - 1)) >= 4 * (n + _n)"
    left = first.withColumnRenamed("shingle", "_shingle")
    met = left.join(other, (left["_shingle"] == other["shingle"]) & F.expr(fits))
    return met.select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct()


def near_components(texts: DataFrame, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, label of every node with a near copy. texts: node, _text; equal texts have one node. linked gives pairs u, v
    of nodes of texts that are verified first; what they tie together the bands need not verify again."""
    spark = texts.sparkSession
    text_batches(spark)
    first = None
    if linked:
        first = _settled(texts, checkpointed(linked(texts)))
        released(spark)
        tied = components(first)
    bands = written(texts.select("node", "_text").mapInArrow(_bands, "key long, node long, n long"))
    centres = bands.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("_last"), F.min_by("n", "node").alias("_n"), F.count(F.lit(1)).alias("size"))
    met = written(bands.join(centres.filter("v <> _last").drop("_last"), "key"))
    discard(bands)
    star = met.filter("node <> v AND 5 * least(n, _n) >= 4 * greatest(n, _n)").select(F.col("node").alias("u"), "v").distinct()
    if first is not None:
        for end in ("u", "v"):
            star = star.join(tied.toDF(end, f"_{end}"), end, "left")
        star = star.filter("coalesce(_u, u) <> coalesce(_v, v)").select("u", "v")
    edges = _settled(texts, checkpointed(star))
    released(spark)
    label = components(edges if first is None else ties(tied).unionByName(edges))
    # Buckets of two are settled. Of larger ones in several components, pairs across these are open.
    placed = met.filter("size > 2").select("key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    open_nodes = checkpointed(placed.join(mixed, "key", "left_semi").select("node", "label").distinct())
    if open_nodes.isEmpty():
        return label
    pairs = checkpointed(prefix_pairs(semi_texts(texts, open_nodes.select("node")), open_nodes))
    more = _settled(texts, pairs)
    discard(met)
    released(spark)
    return label if more.isEmpty() else components(ties(label).unionByName(more))


def ties(label: DataFrame) -> DataFrame:
    """u, v: each node with its label, as edges that tie together what the edges behind the labels did, however many."""
    return label.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))


def _settled(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs u, v that are near, as a table."""
    return written(verified(pairs, semi_texts(texts, pairs.select(F.col("u").alias("node")).union(pairs.select("v")))))


def semi_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, _text of these nodes, once each."""
    nodes = checkpointed(nodes.distinct())
    small = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(nodes) if small else nodes, "node", "left_semi").dropDuplicates(["node"])


def drop_near(docs: DataFrame, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents that stay: of each component of near copies the one with the least doc_id.

    Rows are named by doc_id and text, so that rows that share an id are judged each by its own text; of those with
    the least id one text stays. Rows with a null id stay. Texts without words are near copies of each other.
    """
    node = F.xxhash64(whole("text"))
    label = near_components(docs.select(node.alias("node"), whole("text").alias("_text")), linked)
    rows = written(docs.select("doc_id", node.alias("node")).filter("doc_id IS NOT NULL").distinct())
    tagged = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = tagged.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    gone = tagged.join(first, "label").filter(F.struct("doc_id", "node") != F.col("_first"))
    gone = checkpointed(gone.select(F.col("doc_id").alias("_gone"), F.col("node").alias("_node")))
    small = gone.limit(5 * BROADCAST_ROWS + 1).count() <= 5 * BROADCAST_ROWS
    same = (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(whole(docs["text"])) == gone["_node"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
