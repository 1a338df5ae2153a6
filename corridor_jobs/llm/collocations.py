"""Collocations: frequent phrases that keep together, from vertical positional inverted lists.

Texts are inverted in blocks of one language: each block has the list of positions of every word in it, with a gap in the
count wherever a piece ends. Lists are kept as Parquet and read once for each length. A phrase is extended by merging its
positions with the lists of adjacent words, where both the phrase and what follows its first word are frequent; the
length of the new list is its frequency in the block, and Spark sums the blocks by a 64-bit key of the phrase. Which keys
are frequent comes back to the blocks as a bit map of fixed size. In the end the phrases that pass are summed once more, by
their words: one that passed by chance only cost a list, as this sum decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_SENT, UPPER, discard, released, rows_sent, table, whole, written
from .rolling import mixed
from .word_arrays import codes, table_of, words

LONGEST, LEAST, TOP = 4, 30, 2000
#: Per mille that a longer phrase has of a shorter one's occurrences, from which on the shorter one is part of it.
WITHIN = 800
BLANKS, BREAKS = b" \t", b".,;:!?\n\v\f\r"
SEPARATORS, BREAK = table_of(BLANKS + BREAKS), table_of(BREAKS)
BLOCK_BYTES = 2 << 20
#: Blocks that are sent to a Python worker together.
BLOCKS_SENT = 2
#: Bits of the map, 8 MB.
BITS = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UNKNOWN = "und"


def inverted(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, the length of each one's list, and all lists, one after the other. Words of two pieces are two apart at
    least."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    start, end = words(data, SEPARATORS)
    if not len(start):
        return [], np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    broken = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int32)])
    position = np.arange(len(start), dtype=np.int32)
    position[1:] += np.cumsum(broken[start[1:]] > broken[end[:-1]], dtype=np.int32)
    _, first, own, size = np.unique(codes(data, start, end), return_index=True, return_inverse=True, return_counts=True)
    body = data.tobytes()
    return [body[a:b] for a, b in zip(start[first], end[first], strict=True)], size.astype(np.int32), position[np.argsort(own, kind="stable")]


_LISTS = "lang string, words array<string>, sizes array<int>, positions binary"


def lists(docs: DataFrame) -> DataFrame:
    """lang, words, sizes, positions: a row for every block, each position as its distance from the one before, which packs
    well. docs: _lang, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def blocks() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                found, sizes, positions = inverted(texts)
                if found:
                    columns = [[lang], [found], [sizes], [np.diff(positions, prepend=np.int32(0)).tobytes()]]
                    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "words", "sizes", "positions"])
            held.clear()

        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1])
                if size >= BLOCK_BYTES:
                    yield from blocks()
                    size = 0
        yield from blocks()

    return docs.select("_lang", F.col("_text").cast("binary")).mapInArrow(run, _LISTS)


def word_codes(found: list[bytes]) -> np.ndarray:
    size = np.array([len(w) for w in found], dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    return codes(np.frombuffer(b" ".join(found), dtype=np.uint8), end - size, end) if found else np.zeros(0, dtype=np.uint64)


def _keys(code: np.ndarray, lang: str) -> np.ndarray:
    return mixed(code ^ word_codes([b"=" + lang.encode()])[0])


def _set(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    cell = (key & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) != 0


def bit_map(frequent: DataFrame) -> np.ndarray:
    """The map of some keys (key). What comes to the driver is the map, of BITS bits at most."""
    cell = F.col("key").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 AS INT))")
    cells = written(frequent.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(bit).alias("bits")))
    got = cells.toPandas()  # of a table: what made it need not be kept
    discard(cells)
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def grown(lang: str, found: list[bytes], sizes: np.ndarray, positions: np.ndarray, maps: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length from one word to longest, or to one more than there are maps: the block's phrases all parts of
    which are in the maps of their lengths, as rows of word numbers; the length of each one's list; and its key."""
    code = word_codes(found)
    key = _keys(code, lang)
    yield np.arange(len(found))[:, None], sizes.astype(np.int64), key
    word_at = np.full(int(positions.max(initial=-1)) + 2, -1, dtype=np.int64)
    word_at[positions] = np.repeat(np.arange(len(found)), sizes)
    place = np.flatnonzero(word_at >= 0)
    phrase, members, total = word_at[place], np.arange(len(found))[:, None], code
    for length in range(1, min(longest, len(maps) + 1)):
        keep = _set(maps[length - 1], key)[phrase]
        place, phrase = place[keep], phrase[keep]
        follows = np.flatnonzero(place[1:] == place[:-1] + 1)  # the lists of the phrase and of its neighbour, merged
        place, phrase = place[follows], phrase[follows]
        own, phrase, count = np.unique(phrase * len(found) + word_at[place + length], return_inverse=True, return_counts=True)
        before, last = (own // len(found), own % len(found)) if len(found) else (own, own)
        members = np.hstack([members[before], last[:, None]])
        total = total[before] * _BASE + code[last]
        key = _keys(total, lang)
        yield members, count, key


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), b.column(1)[k].values, b.column(2)[k].values.to_numpy(), np.cumsum(np.frombuffer(b.column(3)[k].as_py(), dtype=np.int32), dtype=np.int32)


def key_counts(every: DataFrame, maps: list[np.ndarray]) -> DataFrame:
    """key, n by block: the lists of one more word than maps has lengths."""
    sent = every.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own, sizes, positions in _blocks(batches):
            *_, (_, count, key) = grown(lang, own.cast(pa.binary()).to_pylist(), sizes, positions, sent.value, len(sent.value) + 1)
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "n": count})

    return every.mapInArrow(run, "key long, n long")


def phrase_counts(every: DataFrame, maps: list[np.ndarray]) -> DataFrame:
    """lang, words, phrase, n by block, of the phrases in the maps (by length, from one word on)."""
    sent = every.sparkSession.sparkContext.broadcast(maps)
    names = ["lang", "words", "phrase", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own, sizes, positions in _blocks(batches):
            for bits, (members, count, key) in zip(sent.value, grown(lang, own.cast(pa.binary()).to_pylist(), sizes, positions, sent.value, len(sent.value)), strict=False):
                passed = _set(bits, key)
                part, n = members[passed], count[passed]
                text = pc.binary_join_element_wise(*(own.take(pa.array(part[:, j])) for j in range(part.shape[1])), " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), type=pa.string()), pa.array([part.shape[1]] * len(n), type=pa.int32()), text, pa.array(n, type=pa.int64())], names=names)

    return every.mapInArrow(run, "lang string, words int, phrase string, n long")


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, words (their number), phrase, f of every phrase with f >= least; and lang, n (all occurrences of words)."""
    spark = docs.sparkSession
    with rows_sent(spark, ROWS_SENT):
        every = written(lists(docs), "zstd", group_rows=1)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n)
    totals = written(every.groupBy("lang").agg(F.sum(size).alias("n")))
    with rows_sent(spark, BLOCKS_SENT):
        maps: list[np.ndarray] = []
        for _ in range(longest):
            maps.append(bit_map(key_counts(every, maps).groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)))
            released(spark)
        sums = phrase_counts(every, maps).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
        found = written(sums.filter(F.col("f") >= least))
    discard(every)
    released(spark)
    return found, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language.

    Texts have A-Z in lower case, end a piece at . , ; : ! ? and line ends, and a word at blanks and tabs; phrases stay
    within a piece. a is how often the phrase occurs (least or more), n all words of the language. Cut after k words it
    has parts that occur l and r times; score is floor(2000000 a / (l + r)) at the lowest cut (of equals the first). A
    phrase that a longer one with 80 % of its occurrences holds is left out. Ranks go by score, a, and the phrase's bytes.

    A null lang is "und", a null text empty. Very long texts are inverted in one block. Words are told apart by 64 bits
    within a block. Rows that repeat count each. Extra columns are ignored; an empty table gives no rows.
    """
    every, totals = frequencies(docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("_lang"), whole(text_col).alias("_text")), least, longest)
    known = every.select("lang", "phrase", "f")
    long = every.filter("words > 1")
    word = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), piece(1, k).alias("left"), piece(k + 1, F.col("words")).alias("right")))
    cut = long.select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    cut = cut.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    cut = cut.withColumn("score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div CAST(l + r AS DECIMAL(20, 0))"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    inner = lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: piece(i, F.lit(n)))
    shorter = [F.when(F.col("words") > n, inner(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest)] or [F.array().cast("array<string>")]
    parts = long.select("lang", "f", F.explode(F.concat(*shorter)).alias("phrase"))
    held = parts.groupBy("lang", "phrase").agg(F.max("f").alias("_held"))
    free = lowest.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.expr(f"CAST(_held AS DECIMAL(20, 0)) * 1000 < CAST(a AS DECIMAL(20, 0)) * {WITHIN}"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, 5)) AS m FROM q) x) y) z
  GROUP BY lang, m, phrase
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {LEAST}),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(ws[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(ws[k + 1:], ' ')
), lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut) WHERE o = 1),
held AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM (
    SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c) x) y
  GROUP BY 1, 2
), ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
  FROM lowest o LEFT JOIN held h ON h.lang = o.lang AND h.phrase = o.phrase WHERE most IS NULL OR 1000 * most < {WITHIN} * a
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= {TOP}
"""
