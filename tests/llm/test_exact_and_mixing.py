from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corridor_jobs.llm import exact_dedup, mixing
from tests.llm.edge_cases import documents, plain


def lowered(text):
    return text.encode().lower()


@pytest.mark.parametrize("every", [True, False])
def test_groups_equal_brute_force(spark, every):
    docs = documents(spark)
    groups = defaultdict(list)
    for i, t in plain(docs):
        groups[lowered(t)].append(i)
    want = sorted((i, max(groups[lowered(t)]), len(groups[lowered(t)]), i == max(groups[lowered(t)])) for i, t in plain(docs))
    got = exact_dedup.exact_groups(docs, digest_all=every).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    sha = {i: hashlib.sha256(lowered(t)).hexdigest() for i, t in plain(docs)}
    assert all(r.text_sha256 == sha[r.doc_id] for r in got if every or r.group_size > 1)


def test_null_ids_and_no_rows(spark):
    docs = documents(spark, ids=False)
    assert exact_dedup.exact_groups(docs).count() == docs.count()
    assert exact_dedup.exact_groups(docs.filter("false")).isEmpty()
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns and left.filter("doc_id IS NULL").count() == 1


def test_only_ascii_is_lowered(spark):
    docs = spark.createDataFrame([(1, "ÄB"), (2, "Äb"), (3, "äb")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {1: 2, 2: 2, 3: 3}


def filled(sizes):
    """Targets by repeated resharing, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        wsum = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else free * weight[s] / wsum for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] and s not in capped}
        if not over:
            return target
        capped |= over


def test_targets_and_shares(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert target == pytest.approx(filled(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 40 for s in target)
    words = {i: len(t.encode().split()) for i, t in plain(docs)}
    assert all(r.size == words[r.doc_id] for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_low_targets_are_capped(spark):
    rows = [(i, "w " * (1 if i % 50 == 0 else 40), "a" if i % 50 == 0 else "b", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    assert {r.target for r in got if r.source == "a"} == {12.0}
    assert sum(r.taken for r in got if r.source == "a") <= 12


def test_no_documents_and_drawn_copies(spark):
    docs = documents(spark)
    assert mixing.mix(docs.filter("false")).isEmpty()
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 6 and copies[60] == copies[61] == 1


def test_van_der_corput_points_are_spread(spark):
    points = sorted(r.point for r in mixing.slot_points(spark, 100).collect())
    assert len(set(points)) == 100 and max(b - a for a, b in zip(points, points[1:], strict=False)) <= 1 / 64


@pytest.mark.parametrize("every", [True, False])
def test_ids_with_two_texts_and_null_ids_keep_a_row_each(spark, every):
    start = "s" * exact_dedup.PREFIX_CHARS
    rows = [(1, start + "a"), (1, start + "b"), (2, start + "A"), (None, start + "a"), (None, "z"), (None, "z"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, digest_all=every).collect()
    want = [(1, 2, 3, False), (1, 1, 1, True), (2, 2, 3, True), (None, 2, 3, False), (None, None, 2, True), (None, None, 2, True), (4, 5, 2, False), (5, 5, 2, True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted(want, key=key)
    left = [tuple(r) for r in exact_dedup.drop_exact(docs).collect()]
    assert sorted(left, key=key) == sorted([rows[k] for k in (1, 2, 4, 5, 7)], key=key)  # no text is lost


def test_draw_with_columns_of_any_name(spark):
    docs = documents(spark, 10)
    named = docs.selectExpr("*", "1 AS _copies", "2 AS _id", "3 AS _copy", "4 AS _row")
    got = mixing.draw(named)
    assert got.columns == named.columns and got.count() == mixing.draw(docs).count()


def test_a_source_of_forty_words_among_millions_has_them(spark):
    big = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 20_000).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    few = spark.createDataFrame([(1000 + i, "few " * 10, "c") for i in range(4)], "doc_id long, text string, source string")
    docs = big.unionByName(few)
    sums = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()}
    assert (sums["c"].size, sums["c"].target, sums["c"].taken) == (40, 120.0, 120)
    assert all(r.taken == int(r.target + 0.5) for r in sums.values())  # to the word, at any size
    assert mixing.draw(docs).filter("source = 'c'").count() == 12


def test_every_block_has_one_slot(spark):
    quotas = spark.createDataFrame([("a", False, 70_000, 0.0, 0.69), ("b", False, 1, 0.69, 0.69001), ("", True, 300, 0.69001, 0.6935), ("z", False, 31_111, 0.6935, 2.0)], "_src string, _no boolean, quota long, low double, high double")
    got = mixing.schedule(spark, quotas, 100).collect()
    blocks = {(s, i) for s, n in (("a", 700), ("b", 1), ("", 3), ("z", 312)) for i in range(n)}
    assert {(r._src, r.block) for r in got} == blocks and sorted(r.slot for r in got) == list(range(len(blocks)))
    first = [r.slot for r in got if r._src == "a" and r.block < 350]
    assert max(first) < 0.55 * len(blocks)  # half of a source comes in half the schedule


def test_rows_that_share_an_id_have_their_own_copies(spark):
    rows = [(1, "w " * 1000, "a"), (1, "x " * 10, "b"), (1, None, "b"), (2, "y " * 90, "b"), (None, "z " * 50, "a"), (3, "q " * 30, "a"), (3, "q " * 30, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect() if r.size != 30}
    counts = {(r.doc_id, r.text): r["count"] for r in mixing.draw(docs).groupBy("doc_id", "text").count().collect()}
    for i, text, _ in rows[:5]:
        size = len((text or "").split())
        assert counts.get((i, text), 0) == (int(taken[i, size] / size + 0.5) if size else 1)
    assert len({mixed for mixed in counts.values()}) > 1


def test_a_source_whose_documents_all_round_to_none_stays(spark):
    docs = spark.createDataFrame([(1, "w " * 1000, "b"), *((10 + i, "x " * 9, "a") for i in range(3)), (2, "v " * 900, "c"), (3, "u " * 7000, "d")], "doc_id long, text string, source string")
    assert {r.source for r in mixing.draw(docs).collect()} == {"a", "b", "c", "d"}
