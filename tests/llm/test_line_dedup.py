from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.llm import line_dedup
from tests.llm.edge_cases import documents, plain


def slow(rows, run):
    """doc -> (n_lines, n_removed, kept, longest run that also starts elsewhere), from all starts of all runs."""
    lines = {i: text.split("\n") if text else [] for i, text in rows}
    seq = {i: [k for k, x in enumerate(ls) if x.encode().strip(b" \t\n\v\f\r")] for i, ls in lines.items()}
    starts: dict[tuple, list] = {}
    for i, at in seq.items():
        for p in range(len(at)):
            for q in range(p + 1, len(at) + 1):
                starts.setdefault(tuple(lines[i][k] for k in at[p:q]), []).append((i, p))
    out = {}
    for i, text in rows:
        ls, at = lines[i], seq[i]
        gone, longest = set(), 0
        for key, places in starts.items():
            own = [p for j, p in places if j == i]
            if len(places) > 1 and own:
                longest = max(longest, len(key))
                if len(key) == run:
                    gone |= {p + k for p in own if (i, p) != min(places) for k in range(run)}
        dropped, last = set(), False
        for k in range(len(ls)):
            last = at.index(k) in gone if k in at else last
            if last:
                dropped.add(k)
        out[i] = (len(ls), len(dropped), "\n".join(x for k, x in enumerate(ls) if k not in dropped), longest)
    return out


def given(got):
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept, r.longest_run) for r in got.collect()}


@pytest.mark.parametrize("run", [1, 2, 3])
def test_deleted_lines_and_longest_runs_equal_brute_force(spark, run):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice(list("abcdefghijklm") + [" ", ""], rng.integers(1, 14)))) for i in range(30)]
    rows += [(40, rows[3][1]), (41, ""), (42, None), (43, "\n a\n\na\n\n"), (44, "\n".join("xy" * 9)), (45, " \n\t"), (46, " \n\t"), (47, rows[3][1])]
    rows += [(50, "\n".join(f"only {k}" for k in range(9))), (51, "\n".join(["new"] + [f"only {k}" for k in range(1, 8)])), (52, "one line"), (53, "one line")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int")
    want = slow([(i, t or "") for i, t in rows], run)
    got = given(line_dedup.deduplicated(docs, min_lines=run))
    assert got == want
    assert got[51][3] == 7 and got[53][1] == (1 if run == 1 else 0)
    assert line_dedup.deduplicated(docs.filter("false")).isEmpty()


def test_awkward_documents(spark):
    docs = documents(spark, 20)
    got = line_dedup.deduplicated(docs).collect()
    assert len(got) == docs.count()
    want = slow(sorted(set(plain(docs.filter("length(text) < 5000 OR text IS NULL")))), 1)
    assert all((r.n_lines, r.n_removed, r.kept, r.longest_run) == want[r.doc_id] for r in got if r.doc_id in want)


def test_repeated_rows_ids_and_null_ids(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "c\nd"), (None, "b\nc\nd")]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    assert {(r.doc_id, r.kept) for r in got if r.kept not in ("", "a")} == {(None, "b\nc\nd")}
    assert sorted(r.kept for r in got if r.doc_id == 1) == ["", "a", "a"]


def test_ranks_and_common_prefixes_equal_sorted_suffixes(spark):
    rng = np.random.default_rng(2)
    seqs = [list(rng.choice(list("abcd"), n)) for n in (9, 14, 3, 1, 20)] + [list("abcdabcdabcd")] * 2 + [["z", "a", "b"]]
    lines = spark.createDataFrame([(d, i, ord(x), 0) for d, s in enumerate(seqs) for i, x in enumerate(s)], "d long, i int, a long, b long")
    found = line_dedup.suffixes(lines)
    rank = {x: r.line for r, x in ((r, chr(r.a)) for r in lines.join(found, ["d", "i"]).select("a", "line").distinct().collect())}
    ranks, levels, _ = line_dedup.suffix_array(found)
    table = {(r.d, r.i): r["rank"] for r in ranks.collect()}
    cut = {(d, i): [rank[x] for x in s[i : i + next((k for k, x in enumerate(s[i:]) if x not in rank), len(s))]] for d, s in enumerate(seqs) for i, x in enumerate(s) if x in rank}
    order = sorted(cut.values())
    assert table == {k: order.index(v) for k, v in cut.items()} and "z" not in rank
    distinct = sorted(map(list, set(map(tuple, order))))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {order.index(b): shared(a, b) for a, b in zip([[], *distinct], distinct, strict=False)}
    assert {r["rank"]: r.lcp for r in line_dedup.prefixes(ranks, levels).collect()} == want


def test_lines_of_distinct_texts_are_carried_once(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    assert line_dedup.sequences(docs).count() == 1
    got = line_dedup.deduplicated(docs).groupBy("n_removed", "longest_run").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2, 1), (2, 2, 199)]
