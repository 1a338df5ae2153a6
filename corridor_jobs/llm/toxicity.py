"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled. Word forms that keep to toxic documents label the tokens of those documents; the field
learns from such windows of tokens what the forms look like (the form itself, its beginnings and ends) and how toxic
tokens follow one another. Forward-backward marginals over whole texts give the expected number of toxic tokens and the
largest marginal of each document; a logistic fit on training documents turns these into a score.

The fit uses at most TRAIN_DOCS labelled documents for the forms, WINDOWS windows of these for the field, and SCORED_DOCS
documents for the logistic (parameters), so what the driver gathers is bounded. Windows of WINDOW tokens cover the whole
of each training text; half of those taken are of toxic texts and have a toxic token, half are of clean texts, each the
ones of least hash. All forms of the training documents that keep to toxic ones count: in MIN_DOCS of them or more, with a lift of LIFT or more. Features
have their own names, so none share a weight; one that no window shows has weight 0. Scoring covers every document and
the whole of its text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_batches, whole, without_rows, written

TRAIN_DOCS = 20_000
SCORED_DOCS = 5_000
WINDOWS, WINDOW = 2_000, 64
#: Documents tagged at a time, and forms whose emissions a worker remembers.
ROWS, REMEMBERED = 512, 200_000
MIN_DOCS, LIFT = 3, 2.5
FOLDS, HELD_OUT = 5, 0
#: Features of a token at most.
MOST_FEATURES = 9
BLOCK = 64
#: Bounds within which chains are scaled and not taken in logarithms.
SMALLEST, LARGEST = 1e-250, 250.0
TOKEN = re.compile(r"[^\W_]+")
ARROW = [pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
EMPTY_SCHEMA = "doc_id {id}, text_key long, expected double, largest double, n_tokens long, starts array<int>, ends array<int>"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Field:
    """Two states. Weights say how much a feature, by its name, favours toxic; the rest are log potentials."""

    forms: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def features(self, form: str) -> list[str]:
        names = [f"={form}", f"~{self.forms.get(form, -1)}", "*"]
        return names + [f"^{form[:k]}" for k in (3, 4, 5, 6) if len(form) > k] + [f"${form[-k:]}" for k in (2, 4) if len(form) > k]

    def emission(self, form: str) -> float:
        return float(sum(self.weights.get(f, 0.0) for f in self.features(form)))


def counted(train: DataFrame, min_docs: int = 1) -> DataFrame:
    """form, toxic, clean: documents of each kind that have the form. train has _text and toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(pdf["_text"], pdf["toxic"], strict=True):
                count[int(toxic)].update({t.lower() for t in set(TOKEN.findall(text))})
            keys = list(count[0].keys() | count[1].keys())
            yield pd.DataFrame({"form": keys, "toxic": [count[1][k] for k in keys], "clean": [count[0][k] for k in keys]})

    each = train.select("_text", "toxic").mapInPandas(run, "form string, toxic long, clean long")
    return each.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= min_docs)


def windows(train: DataFrame, forms: dict[str, int], most: int = WINDOWS // 2) -> DataFrame:
    """at, tokens, marks, marked: at least the `most` windows of least at among those of toxic texts with a marked token,
    and among those of clean texts. Windows lie end to end over the whole of each text of train (_text, toxic, _at)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: tuple[list, list] = ([], [])
        for pdf in batches:
            for text, toxic, at in zip(pdf["_text"], pdf["toxic"], pdf["_at"], strict=True):
                words = [t.lower() for t in TOKEN.findall(text)]
                for lo in range(0, len(words), WINDOW):
                    part = words[lo : lo + WINDOW]
                    marks = [int(bool(toxic) and forms.get(w, -1) > 0) for w in part]
                    if any(marks) or not toxic:
                        least[any(marks)].append((zlib.crc32(f"{at} {lo}".encode()), part, marks))
                for found in least:
                    if len(found) > 4 * most:
                        found[:] = heapq.nsmallest(most, found)
        for marked, found in enumerate(least):
            if found:
                found = heapq.nsmallest(most, found)
                yield pd.DataFrame({"at": [w[0] for w in found], "tokens": [w[1] for w in found], "marks": [w[2] for w in found], "marked": bool(marked)})

    return train.select("_text", "toxic", "_at").mapInPandas(run, "at long, tokens array<string>, marks array<int>, marked boolean")


def fit_field(forms: dict[str, int], sample: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.1, decay: float = 1e-4, chain: bool = True) -> Field:
    """Maximum likelihood by Adam on all windows at once; without chain, tokens do not depend on their neighbours."""
    crf = Field(forms)
    n, known, names = len(sample), {}, {}
    if not n:
        return crf
    x = np.full((n, WINDOW, MOST_FEATURES), -1, dtype=np.int32)
    y = np.zeros((n, WINDOW))
    mask = np.zeros((n, WINDOW))
    for i, (tokens, marks) in enumerate(sample):
        for j, t in enumerate(tokens):
            if t not in known:
                own = [names.setdefault(f, len(names)) for f in crf.features(t)]
                known[t] = own + [-1] * (MOST_FEATURES - len(own))
            x[i, j], y[i, j], mask[i, j] = known[t], marks[j], 1
    size = len(names) + 1
    x %= size  # no feature reads the last weight, which stays 0
    flat = x.reshape(-1)
    theta = np.zeros(size + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        e = theta[:size][x].sum(axis=2)
        p, pairs = _marginals(e, mask, theta[size], theta[size + 1 :].reshape(2, 2))
        g = np.zeros_like(theta)
        g[:size] = np.bincount(flat, weights=np.repeat(((y - p) * mask).ravel(), MOST_FEATURES), minlength=size)
        g[size - 1] = 0
        g[size] = (y[:, 0] - p[:, 0]).sum()
        both = mask[:, 1:] * mask[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                seen = (np.where(y[:, :-1] == a, 1, 0) * np.where(y[:, 1:] == b, 1, 0) * both).sum()
                g[size + 1 + 2 * a + b] = seen - pairs[a, b]
        g = g / n - decay * theta
        g[size:] *= chain
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    crf.weights = dict(zip(names, theta[: size - 1].tolist(), strict=True))
    crf.start, crf.step = float(theta[size]), theta[size + 1 :].reshape(2, 2)
    return crf


def _marginals(e: np.ndarray, mask: np.ndarray, start: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals of windows padded at their end, and expected transitions, by forward-backward in logarithms."""
    n, length = e.shape
    a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    a[:, 0, 1] = e[:, 0] + start
    for t in range(1, length):
        a[:, t, 0] = np.logaddexp(a[:, t - 1, 0] + step[0, 0], a[:, t - 1, 1] + step[1, 0])
        a[:, t, 1] = np.logaddexp(a[:, t - 1, 0] + step[0, 1], a[:, t - 1, 1] + step[1, 1]) + e[:, t]
    for t in range(length - 2, -1, -1):
        on = mask[:, t + 1]
        zero, one = b[:, t + 1, 0], b[:, t + 1, 1] + e[:, t + 1]
        b[:, t, 0] = on * np.logaddexp(zero + step[0, 0], one + step[0, 1])
        b[:, t, 1] = on * np.logaddexp(zero + step[1, 0], one + step[1, 1])
    both = a + b
    z = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    p = np.exp(both[:, :, 1] - z[:, None]) * mask
    pairs, on = np.zeros((2, 2)), mask[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            gain = a[:, :-1, i] + step[i, j] + b[:, 1:, j] + (e[:, 1:] if j else 0) - z[:, None]
            pairs[i, j] = (np.exp(np.minimum(gain, 0)) * on).sum()
    return p, pairs


def chain_marginals(e: np.ndarray, lengths: np.ndarray, start: float, step: np.ndarray) -> np.ndarray:
    """Marginals of many chains laid end to end, exact at any length.

    Chains are cut into blocks of BLOCK tokens. The forward ratio r = alpha(1) / alpha(0) moves by a fractional linear
    map per token: maps are multiplied over each block (all blocks at once), carried along the blocks of a chain, and
    replayed inside the blocks; likewise backward. Maps are scaled by their sum. Chains in whose maps a number falls below
    SMALLEST of that, or whose emissions are beyond LARGEST, are gone through once more in logarithms.
    """
    pieces = np.exp(step)
    if not (np.abs(step) < LARGEST).all() or np.linalg.cond(pieces) > 1e6:
        return _in_logarithms(e, lengths, start, step)
    out, lost = _chain_ratios(e, lengths, start, step)
    if lost.any():
        rows = np.repeat(lost, lengths)
        out[rows] = _in_logarithms(e[rows], lengths[lost], start, step)
    return out


def _in_logarithms(e: np.ndarray, lengths: np.ndarray, start: float, step: np.ndarray) -> np.ndarray:
    """chain_marginals() chain by chain without scaling."""
    at = np.cumsum(lengths) - lengths
    found = [_marginals(e[None, a : a + n], np.ones((1, n)), start, step)[0][0] for a, n in zip(at, lengths, strict=True) if n]
    return np.concatenate(found) if found else np.zeros(0)


def _chain_ratios(e: np.ndarray, lengths: np.ndarray, start: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and which chains are not to be relied on."""
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    n = int(blocks.sum())
    chain = np.repeat(np.arange(len(lengths)), blocks)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    spot = (first[np.repeat(np.arange(len(lengths)), lengths)] * BLOCK) + np.arange(len(e)) - np.repeat(at, lengths)
    grid = np.zeros(n * BLOCK)
    grid[spot] = np.exp(np.clip(e, -LARGEST, LARGEST))
    lost = np.zeros(n, dtype=bool)
    lost[spot[np.abs(e) > LARGEST] // BLOCK] = True
    here = np.zeros(n * BLOCK, dtype=bool)
    here[spot] = True
    grid, here = grid.reshape(n, BLOCK), here.reshape(n, BLOCK)
    t00, t01, t10, t11 = np.exp(step).ravel()
    rank = np.arange(n) - first[chain]
    order = [np.flatnonzero(rank == k) for k in range(int(rank.max()) + 1)] if n else []
    # Forward: r' = e (t11 r + t01) / (t10 r + t00); a first token has r = e exp(start), the same map for a set r before it.
    ma, mb, mc, md = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(BLOCK):
        x, on = grid[:, t], here[:, t]
        na, nb, nc, nd = x * (t11 * ma + t01 * mc), x * (t11 * mb + t01 * md), t10 * ma + t00 * mc, t10 * mb + t00 * md
        size = na + nb + nc + nd
        lost |= on & ~(np.minimum(np.minimum(na, nb), np.minimum(nc, nd)) > SMALLEST * size)
        size = np.where(on & (size > 0), size, 1)
        ma, mb, mc, md = (np.where(on, new / size, old) for new, old in ((na, ma), (nb, mb), (nc, mc), (nd, md)))
    enter = np.zeros((n, 2))  # (alpha0, alpha1) before each block
    k = np.exp(start)  # the vector that one step turns into (1, exp(start)), up to scale
    u = np.linalg.lstsq(np.array([[t00, t10], [t01, t11]]), np.array([1.0, k]), rcond=None)[0]
    for i, rows in enumerate(order):
        if i == 0:
            enter[rows] = u
        else:
            prev = rows - 1
            one = ma[prev] * enter[prev, 1] + mb[prev] * enter[prev, 0]
            zero = mc[prev] * enter[prev, 1] + md[prev] * enter[prev, 0]
            size = np.abs(one) + np.abs(zero)
            enter[rows, 0], enter[rows, 1] = zero / size, one / size
    forward = np.zeros((2, n, BLOCK))
    zero, one = enter[:, 0].copy(), enter[:, 1].copy()
    for t in range(BLOCK):
        nz, no = t00 * zero + t10 * one, grid[:, t] * (t01 * zero + t11 * one)
        size = np.abs(nz) + np.abs(no)
        size = np.where(size > 0, size, 1)
        zero, one = nz / size, no / size
        forward[0, :, t], forward[1, :, t] = zero, one
    # Backward: (beta0, beta1) before a token from those after it.
    ma, mb, mc, md = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)  # maps (zero, one) after the block to before it
    for t in range(BLOCK - 1, -1, -1):
        x, on = grid[:, t], here[:, t]
        na, nb, nc, nd = t00 * ma + t01 * x * mc, t00 * mb + t01 * x * md, t10 * ma + t11 * x * mc, t10 * mb + t11 * x * md
        lost |= on & ~(np.minimum(np.minimum(na, nb), np.minimum(nc, nd)) > SMALLEST * (na + nb + nc + nd))
        size = np.where(on, na + nb + nc + nd, 1)
        ma, mb, mc, md = (np.where(on, new / size, old) for new, old in ((na, ma), (nb, mb), (nc, mc), (nd, md)))
    leave = np.full((n, 2), 0.5)  # (beta0, beta1) after each block
    lasts = blocks[chain]
    for i in range(len(order) - 2, -1, -1):
        rows = order[i][lasts[order[i]] > i + 1]
        nxt = rows + 1
        zero = ma[nxt] * leave[nxt, 0] + mb[nxt] * leave[nxt, 1]
        one = mc[nxt] * leave[nxt, 0] + md[nxt] * leave[nxt, 1]
        leave[rows, 0], leave[rows, 1] = zero / (zero + one), one / (zero + one)
    out = np.zeros((n, BLOCK))
    zero, one = leave[:, 0].copy(), leave[:, 1].copy()
    for t in range(BLOCK - 1, -1, -1):
        p, q = forward[1, :, t] * one, forward[0, :, t] * zero
        out[:, t] = p / np.where(p + q > 0, p + q, 1)
        on, x = here[:, t], grid[:, t]
        nz, no = t00 * zero + t01 * x * one, t10 * zero + t11 * x * one
        size = np.where(on, nz + no, 1)
        zero, one = np.where(on, nz / size, zero), np.where(on, no / size, one)
    return np.clip(out.ravel()[spot], 0, 1), np.bincount(chain[lost], minlength=len(lengths)) > 0


def text_key(text: Column) -> Column:
    """64 bits by which rows that share an id are told apart."""
    return F.xxhash64(text)


def tag(docs: DataFrame, crf: Field, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, expected (sum of marginals), largest, n_tokens, starts, ends (code points of tokens over threshold).

    Null or empty text has no tokens: 0, 0, 0 and no spans.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(whole(text_col)).alias("text_key"), whole(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, known = shared.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                if len(known) > REMEMBERED:
                    known.clear()
                texts, values, lengths = part.column(2).to_pylist(), [], []
                for text in texts:
                    words = TOKEN.findall(text)
                    lengths.append(len(words))
                    for w in words:
                        x = known.get(w)
                        if x is None:
                            x = known[w] = crf.emission(w.lower())
                        values.append(x)
                size = np.array(lengths, dtype=np.int64)
                p = chain_marginals(np.array(values), size, crf.start, crf.step) if values else np.zeros(0)
                made: dict[str, list] = {"expected": [], "largest": [], "n_tokens": lengths, "starts": [], "ends": []}
                for text, n, stop in zip(texts, lengths, np.cumsum(size), strict=True):
                    own = p[stop - n : stop]
                    hot = set(np.flatnonzero(own >= threshold).tolist())
                    spans = [m.span() for i, m in enumerate(TOKEN.finditer(text)) if i in hot] if hot else []
                    made["expected"].append(float(own.sum()))
                    made["largest"].append(float(own.max()) if n else 0.0)
                    made["starts"].append([s for s, _ in spans])
                    made["ends"].append([e for _, e in spans])
                columns = [pa.array(v, type=kind) for v, kind in zip(made.values(), ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "text_key", *made])

    return src.mapInArrow(run, EMPTY_SCHEMA.format(id=dict(src.dtypes)["doc_id"]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """_text, toxic, _at of at most so many labelled documents outside the held-out fold, those of least hash."""
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    told = told.withColumn("_at", F.pmod(F.xxhash64("_id"), F.lit(1 << 20)).cast("int")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col("doc_id").alias("_id"), whole("text").alias("_text")).join(F.broadcast(told), "_id")


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, learnt from the labelled documents outside the held-out fold; without toxic ones all weights are 0."""
    train = training_rows(docs, labels)
    rate = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1.0)
    base = train.agg(F.avg("toxic")).first()[0] or 0.0
    lift = F.log(rate / (1 - rate)) - float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    telling = counted(train, MIN_DOCS).withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    forms = {r.form: int(r.lift) for r in telling.select("form", "lift").collect()}
    found = written(windows(train, forms))
    sample = [r for marked in (True, False) for r in found.filter(F.col("marked") == marked).orderBy("at", "tokens", "marks").limit(WINDOWS // 2).collect()]
    discard(found)
    return fit_field(forms, [(list(r.tokens), list(r.marks)) for r in sorted(sample)])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 1e-3) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)) * max(1, len(x)) ** 0.5
        w += np.linalg.solve(h, x.T @ (y - p) - decay * max(1, len(x)) ** 0.5 * w)
    return w


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, starts, ends, text_key for every document.

    Learns from labelled documents whose crc32(doc_id) mod 5 is not 0. Repeated labels of a document count as toxic if
    one says so; null labels are left out; a null doc_id is scored but not learnt from. Equal texts score alike, whatever
    their ids; of rows that share a labelled id the logistic learns from the strongest evidence. Texts without tokens get
    the score of no evidence; very long ones are tagged whole, in blocks. No labels: score 0. One row per input row; an
    empty table gives no rows. Extra columns are ignored.
    """
    text_batches(docs.sparkSession)
    crf = fit(docs, labels)
    tagged = written(tag(docs, crf))
    a, b, c = F.log1p("expected"), F.col("largest"), F.col("expected") / F.greatest("n_tokens", F.lit(1))
    told = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    told = told.orderBy(F.xxhash64("_id"), "_id").limit(SCORED_DOCS)
    known = tagged.join(F.broadcast(told), tagged["doc_id"] == told["_id"]).groupBy("doc_id")
    rows = known.agg(F.max(a).alias("a"), F.max(b).alias("b"), F.max(c).alias("c"), F.max("y").alias("y")).collect()
    rows.sort()
    if rows:
        w = fit_logistic(np.array([r[1:4] for r in rows], dtype=float), np.array([r.y for r in rows], dtype=float))
        score = 1 / (1 + F.exp(-(a * float(w[0]) + b * float(w[1]) + c * float(w[2]) + float(w[3]))))
    else:
        score = F.lit(0.0)
    return tagged.withColumn("score", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "starts", "ends", "text_key"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns; each row is judged by its own text."""
    gone = scores(docs, labels).filter("predicted = 1").select("doc_id", "text_key")
    return without_rows(docs, gone, text_key(whole(docs["text"])))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
