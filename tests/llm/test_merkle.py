from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from corridor_jobs.llm import merkle
from tests.llm.edge_cases import documents


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict) -> str:
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(one(row[c]) for c in merkle.FIELDS))


def proofs(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the siblings left and right of each leaf on its way up."""
    place, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for path, i in zip(paths, place, strict=True):
            run = runs[i // 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, place = [h(*r) for r in runs], [i // 8 for i in place]
    return level[0], paths


def brute(rows: list[dict]) -> list[tuple]:
    key = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    trees = []
    for _, own in groupby(sorted(rows, key=key), key=key):
        own = sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, *proofs([leaf(r) for r in own])))
    root, tops = proofs([t[1] for t in trees])
    out = []
    for (own, sub, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            drawn = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf({**r, "text": r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}) if drawn else leaf(r)
            for left, right in path + top:
                now = h(left, now, right)
            out.append((r["doc_id"], leaf(r), sub, root, h(*(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(spark, tmp_path, df) -> list[tuple]:
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op13_merkle(spark, str(tmp_path)).select(NAMES).collect()), key=str)


def test_equals_trees_built_in_one_place(spark, tmp_path):
    df = documents(spark, 300, ids=False)
    got = found(spark, tmp_path, df)
    assert got == brute([r.asDict() for r in df.collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 9, 585])
def test_sizes_about_powers_of_the_fan(spark, tmp_path, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    assert found(spark, tmp_path, df) == brute([r.asDict() for r in df.collect()])


def test_stack_leaves_what_edges_cut(spark):
    """Wherever a partition begins and ends: complete runs inside it are made, each leaf and node is said once."""
    leaves = [("g", 3, i, h(str(i))) for i in range(200)]
    root, _ = proofs([d for *_, d in leaves])
    levels = [[d for *_, d in leaves]]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    for lo, hi in ((0, 200), (0, 64), (3, 200), (7, 73), (60, 61), (8, 16)):
        made = list(merkle.stack(iter(leaves[lo:hi])))
        assert all(d == levels[level][i] for _, _, level, i, d, _ in made)
        want = {(level, i) for level in (1, 2) for i in range(200) if lo <= i * 8**level and (i + 1) * 8**level <= hi}
        assert {(level, i) for _, _, level, i, _, _ in made if level} == want and len(made) == len({m[2:4] for m in made})
        covered = [j for _, _, level, i, _, peak in made if peak for j in range(i * 8**level, (i + 1) * 8**level)]
        assert sorted(covered) == list(range(lo, hi))


def test_tampering_shows_and_paths_prove(spark):
    df = documents(spark)
    done = merkle.verified(df, merkle.leaf_of(text=F.concat(F.coalesce("text", F.lit("")), F.lit("!"))))
    assert done.filter("verified").isEmpty() and done.select("root").distinct().count() == 1
    assert merkle.verified(df).filter("NOT verified").isEmpty()
    assert merkle.verified(df.limit(0)).isEmpty()
