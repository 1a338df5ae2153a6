from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corridor_jobs.llm import collocations
from tests.llm.edge_cases import documents


def brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from dictionaries of all phrases; rows: (lang, text)."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts.setdefault(lang or "und", Counter()).update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        free = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = (q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * cand[q] >= 80 * a for q in inside):
                free.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(free)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df, **more) -> list[tuple]:
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


def test_equals_dictionaries_of_all_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)  # many blocks
    df = documents(spark, 80, ids=False)
    want = brute([(r.lang, r.text) for r in df.collect()], 5, 2000)
    assert found(df, least=5) == want and len(want) > 50
    assert found(df, least=5, top=3) == brute([(r.lang, r.text) for r in df.collect()], 5, 3)


def test_lists_are_read_one_block_at_a_time(spark, monkeypatch):
    """Spark reads a row group of lists at once: all of a file's blocks where there is one group of them."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)
    groups, discard = [], collocations.discard

    def seen(*frames):
        for path in (p for f in frames if "positions" in f.columns for p in Path(f.written_path.removeprefix("file:")).glob("*.parquet")):
            m = pq.read_metadata(path)
            groups.extend(m.row_group(k).num_rows for k in range(m.num_row_groups))
        discard(*frames)

    monkeypatch.setattr(collocations, "discard", seen)
    collocations.collocations(documents(spark, 80, ids=False))
    assert len(groups) > 20 and set(groups) == {1}


def test_overlaps_pieces_and_ties(spark):
    rng = random.Random(3)
    rows = [("en", "a a a a. a a"), ("en", "New\tYork, New York; new york\vYork"), (None, "ü ü\rü ü:ü"), ("und", "Ü ü ü"), ("fr", "")]
    rows += [("en", " ".join(rng.choice(["x", "y", "z", "Z.", "y,x"]) for _ in range(60))) for _ in range(20)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for least in (1, 2, 7):
        assert found(df, least=least) == brute(rows, least, 2000)
    assert {len(r[2].split()) for r in brute(rows, 1, 2000)} == {2, 3, 4}


def test_a_full_map_changes_nothing(spark, monkeypatch):
    """Whatever passes the map by chance is decided by its sum."""
    df = documents(spark, 40)
    want = found(df, least=4)
    monkeypatch.setattr(collocations, "bit_map", lambda frequent: np.full(collocations.BITS // 64, (1 << 64) - 1, dtype=np.uint64))
    assert found(df, least=4) == want


def test_counts_beyond_64_bits_of_product(spark, monkeypatch):
    each = [("en", 1, "p", 6 * 10**15), ("en", 1, "q", 7 * 10**15), ("en", 2, "p q", 5 * 10**15)]
    rows = spark.createDataFrame(each, "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequencies", lambda *a: (rows, totals))
    got = collocations.collocations(documents(spark)).collect()
    assert [(r.phrase, r.score) for r in got] == [("p q", 2000000 * 5 // 13)]


def test_empty_table(spark):
    assert collocations.collocations(documents(spark).limit(0)).isEmpty()
    assert collocations.collocations(documents(spark).withColumn("text", F.lit(None).cast("string"))).isEmpty()
