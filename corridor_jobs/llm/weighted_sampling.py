"""Document fingerprints by consistent weighted sampling.

Terms are words and pairs of neighbouring words (A-Z lower-cased), known by TERM_BITS bits of a hash; their weights are
counts. For each sample k and term there are r and c, Gamma(2, 1), and b, uniform: (r, b) and c are drawn from two seeded
tables of 2 ** DRAW_BITS rows at places that different bits of the term's hash name, so that two terms have all three in
common once in 2 ** (2 DRAW_BITS) pairs, however many terms a text has. A term of weight w has
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the sample of a document is its term of least a, with t. Two
documents agree in a sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger. A sample is named by a hash of its term and t; of terms with one a the least by hash
counts. a is worked out by one formula for all weights, so that equal terms and t have it equal to the last bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, whole
from .rolling import Rolling, mixed

SAMPLES = 64
TERM_BITS, DRAW_BITS = 54, 16
#: Texts sampled together; their number and TERM_BITS fit a long.
TEXTS_AT_ONCE = 500
SEED = 11
ROWS_AT_ONCE = 1 << 15
BYTES_AT_ONCE = 1 << 20
#: Buckets of neighbouring ids per shuffle partition, and at most in all (of about 1 GB each over 100 TB).
BUCKETS_EACH, MOST_BUCKETS = 4, 100_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _random() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and b by one place, and ln c by another, each (places, samples)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    shape = (1 << DRAW_BITS, SAMPLES)
    draw = lambda: rng.random(shape, dtype=np.float32)
    r = -np.log((1 - draw()) * (1 - draw()))
    c = np.log(-np.log((1 - draw()) * (1 - draw()) * np.float32(1 - 1e-7)))
    return r, draw(), c


def _t(weight: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.floor(np.log(weight.astype(np.float64)).astype(np.float32) / r + b)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces of about BYTES_AT_ONCE, cut at white space."""
    while len(data) > BYTES_AT_ONCE:
        cut = next((i for i in range(BYTES_AT_ONCE, len(data)) if _BLANK[data[i]]), len(data))
        yield data[:cut]
        data = data[cut:]
    yield data


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and the text it belongs to."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return Rolling(data).hashes(start, end), owner


def signatures(texts: list[str]) -> np.ndarray:
    """(texts, SAMPLES) of 16 bits each; 0 only where a text has no words. At most 2 ** (64 - TERM_BITS) texts."""
    whole_words: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            h, at = word_hashes(group)
            whole_words.append((h, np.array(owners)[at]))
        group.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.encode().lower()):
            group.append(piece)
            owners.append(i)
            size += len(piece)
            if size > BYTES_AT_ONCE:
                flush()
    flush()
    out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
    if not whole_words:
        return out
    h = np.concatenate([x for x, _ in whole_words])
    doc = np.concatenate([x for _, x in whole_words])
    if not len(h):
        return out
    same = doc[1:] == doc[:-1]
    pair = mixed(h[:-1] * np.uint64(3) + h[1:])[same]
    term = np.concatenate([h, pair]) >> np.uint64(64 - TERM_BITS)
    key = np.concatenate([doc, doc[1:][same]]).astype(np.uint64) << np.uint64(TERM_BITS) | term
    key, weight = np.unique(key, return_counts=True)
    doc = (key >> np.uint64(TERM_BITS)).astype(np.int64)
    place = np.uint64((1 << DRAW_BITS) - 1)
    first_place, second_place = (key & place).astype(np.int64), (key >> np.uint64(DRAW_BITS) & place).astype(np.int64)
    r, b, c = _random()
    least = np.full((len(texts), SAMPLES), np.inf, dtype=np.float32)
    name = np.zeros((len(texts), SAMPLES), dtype=np.uint64)
    for lo in range(0, len(key), ROWS_AT_ONCE):
        s, z, w, d, k = (x[lo : lo + ROWS_AT_ONCE] for x in (first_place, second_place, weight, doc, key))
        rs, bs = r[s], b[s]
        t = np.zeros((len(s), 1), dtype=np.float32)  # of weight 1, whose logarithm is 0
        more = np.flatnonzero(w > 1)
        a = t - bs
        if len(more):
            a[more] = _t(w[more, None], rs[more], bs[more]) - bs[more]
        a *= rs
        np.subtract(c[z], a, out=a)
        a -= rs
        first = np.flatnonzero(np.diff(d, prepend=-1))
        best = np.minimum.reduceat(a, first, axis=0)
        own = d[first]
        row, sample = np.nonzero(a == np.repeat(best, np.diff(np.append(first, len(d))), axis=0))
        row, sample = row[::-1], sample[::-1]  # so that of equals the first is set last
        better = a[row, sample] < least[d[row], sample]
        row, sample = row[better], sample[better]
        at = _t(w[row], rs[row, sample], bs[row, sample]).astype(np.int64).view(np.uint64)
        name[d[row], sample] = mixed((k[row] & np.uint64((1 << TERM_BITS) - 1)) ^ mixed(at + np.uint64(1)))
        least[own] = np.minimum(least[own], best)
    known = np.flatnonzero(np.isfinite(least[:, 0]))
    out[known] = (name[known] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples; 1 for two texts without words, 0 for one."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex, 4 digits a sample) of every whole text; null counts as empty. Narrow."""
    src = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), TEXTS_AT_ONCE):
                part = pdf.iloc[lo : lo + TEXTS_AT_ONCE]
                yield pd.DataFrame({"doc_id": part["doc_id"], "fingerprint": _hex(signatures(part["_text"].tolist()))})

    return src.mapInPandas(run, f"doc_id {dict(src.dtypes)['doc_id']}, fingerprint string")


def _hex(sig: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in sig.astype(">u2")]


def in_order(docs: DataFrame) -> DataFrame:
    """_bucket, _next, doc_id, _text: the documents in order of doc_id within partitions, one shuffle of the texts.

    Quantiles of doc_id cut the documents into buckets; each is followed by a copy (_next = 1) of the first document of
    the next bucket, the last by that of the first. Ids alone are read to find them; the driver sees one id a bucket.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(parts * BUCKETS_EACH, MOST_BUCKETS)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("q")).first().q
    cuts = sorted(set(cuts or []))
    bits = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if cuts:
        kind = dict(docs.dtypes)["doc_id"]
        edges = F.lit(cuts).cast(f"array<{kind}>")
        step = lambda at, bit: at + F.when(F.try_element_at(edges, at + bit) <= F.col("doc_id"), bit).otherwise(0)
        bucket = F.aggregate(F.array(*(F.lit(b) for b in bits)), F.lit(0), step)
    else:
        bucket = F.lit(0)
    rows = docs.select(bucket.alias("_bucket"), F.lit(0).alias("_next"), "doc_id", whole("text").alias("_text"))
    firsts = sorted(rows.groupBy("_bucket").agg(F.min(F.struct("doc_id")).alias("m")).collect())
    if not firsts:
        return rows
    pairs = [(b._bucket, f.m.doc_id) for b, f in zip(firsts, [*firsts[1:], firsts[0]], strict=True)]
    follow = spark.createDataFrame(pairs, f"_to int, _id {dict(docs.dtypes)['doc_id']}")
    copies = docs.join(F.broadcast(follow), docs["doc_id"].eqNullSafe(follow["_id"])).select(
        F.col("_to").alias("_bucket"), F.lit(1).alias("_next"), "doc_id", whole("text").alias("_text")
    )
    return rows.unionByName(copies).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_next", "doc_id", F.xxhash64("_text"), "_text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many from the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    Each text is compared with its edited form and with the next by doc_id (after the last: the first). Null text is
    empty; null ids come first; rows that share an id follow one another by hash of their text. An only document is its
    own next. doc_id is a number. Very long texts are read in pieces and sampled whole. Extra columns are ignored. An empty
    table gives no rows.
    """
    text_batches(docs.sparkSession)
    rows = in_order(docs.select("doc_id", "text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # (bucket, copied, id, text), neighbours in order
        size = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if held and held[-1][1]:
                    if held[-1][0] == row[0]:
                        continue  # a second copy of a repeated first row
                    yield from _compare(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                if (size > BYTES_AT_ONCE and len(held) > 1) or len(held) > TEXTS_AT_ONCE:
                    yield from _compare(held)
                    held, size = held[-1:], len(row[3])
        yield from _compare(held)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInPandas(run, schema)


def _compare(held: list[tuple]) -> Iterator[pd.DataFrame]:
    """Rows for all but the last, which is only a follower."""
    if len(held) < 2:
        return
    texts = [x[3] for x in held]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]  # noqa: B905
    sig, new = signatures(texts), signatures(changed)
    own = sig[:-1]
    yield pd.DataFrame(
        {
            "doc_id": [x[2] for x in held[:-1]],
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": _hex(own),
            "edited_fingerprint": _hex(new),
            "near_edited": likeness(own, new),
            "near_next": likeness(own, sig[1:]),
        }
    )


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
