from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.llm import suffix_levels, token_counts, weighted_sampling
from corridor_jobs.llm.rolling import Rolling
from tests.llm.edge_cases import documents, plain


def jaccard(a, b):
    def terms(t):
        w = t.encode().lower().split()
        return Counter(w) + Counter(zip(w, w[1:], strict=False))

    a, b = terms(a), terms(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    errors = []
    for _ in range(40):
        a = " ".join(rng.choice(words, 200))
        b = a[: len(a) * 2 // 3] + " " + " ".join(rng.choice(words, 70))
        sig = weighted_sampling.signatures([a, b, a])
        assert (sig[0] == sig[2]).all()
        errors.append(float((sig[0] == sig[1]).mean()) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def rate(pairs):
    """Share of equal samples less the likeness, over all pairs, in standard errors."""
    sig = weighted_sampling.signatures([t for p in pairs for t in p])
    errors = np.array([(sig[2 * i] == sig[2 * i + 1]).mean() - jaccard(*p) for i, p in enumerate(pairs)])
    return errors.mean() / (errors.std(ddof=1) / len(errors) ** 0.5), errors.mean()


def test_equal_samples_of_other_weights_are_equal():
    """A text against itself written twice, and mixed weights: within three standard errors of the likeness."""
    rng = np.random.default_rng(12)
    doubled = []
    for k in range(250):
        text = " ".join(f"v{x}" for x in rng.permutation(4000)[:200])
        doubled.append((text, f"{text} {text}"))
    assert abs(jaccard(*doubled[0]) - 0.5) < 0.001
    off, mean = rate(doubled)
    assert abs(off) < 3 and abs(mean) < 0.012
    mixed = []
    for k in range(250):
        words = [f"u{x}" for x in rng.permutation(4000)[:60]]
        mixed.append(tuple(" ".join(np.repeat(words, rng.integers(0, 6, 60))) for _ in range(2)))
    off, mean = rate(mixed)
    assert abs(off) < 3 and abs(mean) < 0.012


def test_long_texts_without_a_common_word_are_unlike():
    a, b = (" ".join(f"{side}{i}" for i in range(100_000)) for side in "xy")
    sig = weighted_sampling.signatures([a, b, a + " " + b])
    assert (sig[0] == sig[1]).mean() < 0.02
    assert abs((sig[0] == sig[2]).mean() - 0.5) < 0.2


def test_rows_agree_with_generalised_jaccard(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    texts = [texts[i - 1][:-400] + " " + " ".join(rng.choice(words, 60)) if i % 2 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near_next, near_edited = [], []
    for r in weighted_sampling.compared(docs).collect():
        text, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        near_next.append(r.near_next - jaccard(text, after))
        near_edited.append(r.near_edited - jaccard(text, weighted_sampling.edited(text, after)))
    for errors in (near_next, near_edited):
        assert abs(np.mean(errors)) < 0.04 and max(map(abs, errors)) < 0.3


def test_compared_with_edited_and_next(spark):
    docs = documents(spark, 25)
    order = sorted(plain(docs))
    got = weighted_sampling.compared(docs).collect()
    assert len(got) == len(order)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    ids = Counter(i for i, _ in order)
    for k, (i, text) in enumerate(order):
        if ids[i] > 1:
            continue
        after = order[(k + 1) % len(order)][1]
        n = len(text)
        want = text[: n - n // 4] + after[: n // 4]
        r = by_id[i][0]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(want.encode()).hexdigest())
        if text == want:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    same = defaultdict(set)
    texts = dict(plain(docs))
    for r in got:
        same[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert weighted_sampling.compared(docs.filter("false")).isEmpty()
    assert weighted_sampling.compared(docs.filter("doc_id = 2")).first().near_next == 1.0
    assert weighted_sampling.compared(documents(spark, 3, ids=False)).filter("doc_id IS NULL").count() == 1


def test_rolling_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"xxabcabcyabc" * 3, dtype=np.uint8)
    h = Rolling(data).windows(3)
    same = defaultdict(set)
    for i in range(len(h)):
        same[bytes(data[i : i + 3])].add(int(h[i]))
    assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)


def slow_removal(rows, length=100):
    seen, out = {}, {}
    for i, text in rows:
        data = text.encode()
        step = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p : p + length], (i, p)) != (i, p):
                step[p] += 1
                step[p + length] -= 1
        gone = np.cumsum(step)[: len(data)] > 0
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_removed_bytes_equal_brute_force(spark, batches):
    docs = documents(spark, 40).filter("length(text) < 5000 OR text IS NULL")
    shift = spark.createDataFrame([(100 + i, "ab" * (60 + i) + "é" * i) for i in range(5)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(shift)
    want = slow_removal(sorted(set(plain(docs))))
    got = suffix_levels.deduplicated(docs, batches=batches, kept_text=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed


def test_long_texts_in_pieces_and_levels_that_merge(spark, monkeypatch):
    monkeypatch.setattr(suffix_levels, "PIECE_BYTES", 256)
    texts = [(1, bytes(97 + (i * i) % 23 for i in range(1500))), (2, b"q" * 40), (3, b"xy" * 600), (4, b"xy" * 90)]
    found, again = [], {}
    for made in suffix_levels.rows_of(iter(texts)):
        for doc, at, n, segment, told in zip(*(made[k].tolist() for k in ("doc", "at", "n", "segment", "again")), strict=True):
            found += [(doc, at + k) for k in range(n)]
            again.setdefault((doc, segment), []).append((at, told))
    assert sorted(found) == [(i, k) for i, t in texts for k in range(len(t) - 99)]
    assert all([told for _, told in sorted(places)] == [k > 0 for k in range(len(places))] for places in again.values())


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "_id long, _text string")


def test_levels_merge_and_outlive_a_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(5000)]
    rows = [(i, " ".join(rng.choice(words, 40))) for i in range(12)]
    rows = [(i, t + " " + rows[i - 4][1][30:230] if i in (5, 8, 11) else t) for i, t in rows]
    want = slow_removal(rows)
    root, got, powers = f"{tmp_path}/index", {}, []
    for lo in (0, 3, 6, 9):
        index = suffix_levels.Levels(spark, root)  # opened anew, as by another job
        found = suffix_levels.added(index, texts_of(spark, rows[lo : lo + 3]), texts_of(spark, rows[:lo]))
        for r in found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("r")).collect():
            got[r.doc] = sum(len(range(*x)) for x in merged(r.r))
        powers.append([p for p, _ in index.tables])
    assert powers == [[0], [0, 0], [1, 0], [1, 0, 0]]
    assert got == {i: w[1] for i, w in want.items() if w[1]} and sorted(got) == [5, 8, 11]
    index = suffix_levels.Levels(spark, root)
    places = spark.table(index.tables[0][1])
    assert places.columns[:4] == ["gram", "segment", "doc", "at"] and places.count() == places.select("gram", "segment").distinct().count()
    index.close()
    assert index.tables == [] and suffix_levels.Levels(spark, root).tables == []


def merged(stretches):
    out = []
    for a, b in sorted(map(tuple, stretches)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_common_grams_are_compared_string_by_string(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_levels, "CROWD", crowd)
    passage = "".join(chr(97 + (i * i * 7) % 26) for i in range(130))
    docs = spark.createDataFrame([(i, f"{i} start {chr(65 + i) * 50}{passage}{chr(75 + i) * 60} end {i}") for i in range(10)], "doc_id long, text string")
    want = slow_removal(plain(docs))
    for r in suffix_levels.deduplicated(docs, batches=3).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_ids_with_two_texts(spark):
    long_a, long_b = "a quick fox jumps over it " * 3 + "x" * 90, "nothing in common with others at all, " * 2 + "y" * 100
    rows = [(1, long_a), (1, long_b), (2, "tail " + long_b), (1, long_a), (None, "head " + long_a), (None, long_b), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_levels.deduplicated(docs, kept_text=True).collect()
    assert len(got) == len(rows)
    ordered = sorted({(i is not None, i or 0, t or "") for i, t in rows if i != 1})
    assert {r.kept.decode() for r in got if r.doc_id is None} == {t for known, _, t in ordered if not known}
    kept = {(r.doc_id, r.kept.decode()) for r in got if r.doc_id is not None}
    assert kept == {(1, ""), (2, "tail "), (3, "")}  # both texts of 1 stand in the rows without an id


def test_no_rows_and_null_ids(spark):
    docs = documents(spark, 5, ids=False).filter("doc_id IS NULL OR doc_id < 4")
    assert suffix_levels.deduplicated(docs).filter("doc_id IS NULL").count() == 1
    assert suffix_levels.deduplicated(docs.filter("false")).isEmpty()


def test_batches_count_once_and_deletes_take_back(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().isEmpty()
    kind = "source string, lang string, version string, tokens long, tokens_before long"
    first = spark.createDataFrame([("a", "en", "v", 5, 0), ("a", "en", "v", 7, 0), (None, None, "v", 2, 0)], kind)
    assert roll.commit("1", token_counts.inserted(first))
    assert not roll.commit("1", token_counts.inserted(first))
    assert roll.commit("2", token_counts.revised(spark.createDataFrame([("a", "en", "v", 6, 5)], kind)))
    assert roll.commit("3", token_counts.deleted(spark.createDataFrame([("a", "en", "v", 7, 0), (None, None, "v", 2, 0)], kind)))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v", 1, 6)]
    assert roll.commit("4", token_counts.inserted(first.filter("false")))


def test_token_counts_of_awkward_texts(spark):
    docs = documents(spark, 10)
    got = {r.doc_id: r.first for r in token_counts.counted(docs).collect()}
    assert got == {i: len(t.encode().split()) for i, t in plain(docs)}
