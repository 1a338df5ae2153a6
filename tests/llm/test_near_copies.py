from __future__ import annotations

import random

from corridor_jobs.llm import components as components_module
from corridor_jobs.llm import near_copies, simhash
from corridor_jobs.llm.components import components


def slow_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def left(rows):
    """The ids that stay by brute force: of each component at 5-word Jaccard >= 0.8 the least."""
    sets, up = {i: slow_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in up if find(i) == i}


def test_drop_near_equals_brute_force(spark):
    """Edits of one text at similarities around 0.8, a chain of edits, unrelated and short texts."""
    rng = random.Random(3)
    body = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    base, texts = body(150), []
    for _ in range(120):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = body(100)
    for _ in range(15):
        chain[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    texts += [" ".join(body(rng.randrange(1, 60))) for _ in range(60)] + ["", " \n", "one", "ONE", "one two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = left(rows)
    got = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) < len(rows) - 60


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (2, "another text of its own"), (None, text)]
    got = near_copies.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_links_of_fingerprints_come_first(spark, monkeypatch):
    """Without any candidate from the bands, copies whose fingerprints link are found."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join([*w, "more"])), (3 * k + 2, "  ".join(w))]
    rows += [(100, "a b c d e"), (101, "a b c d e f")]  # short texts are near by neither
    print_of = {i: simhash.fingerprint(t) for i, t in rows}
    linked = {i for i in range(36) if any(i // 3 == j // 3 and j < i and (print_of[i] ^ print_of[j]).bit_count() <= 3 for j in range(36))}
    assert len(linked) >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def none(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in ("key", "node", "n")})

    monkeypatch.setattr(near_copies, "_bands", none)
    got = {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert got == {i for i, _ in rows} - linked


def test_components_of_long_chains(spark):
    """A chain in mixed order, one that falls and a star: every node has the least one it reaches, well within the rounds."""
    mixed = random.Random(6).sample(range(10_000, 12_000), 600)
    edges = [*zip(mixed, mixed[1:]), *((1_000 - i, 999 - i) for i in range(300)), *((5_000, 5_001 + i) for i in range(200)), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(mixed, min(mixed)) | dict.fromkeys(range(700, 1_001), 700) | dict.fromkeys(range(5_000, 5_201), 5_000)


def test_edges_of_a_settled_group_are_not_read_again(spark, monkeypatch):
    """All pairs of 60 nodes and a chain: only the first round looks at the pairs, later ones at the chain's edges."""
    pairs = [(i, j) for i in range(60) for j in range(i)]
    chain = [(1_000 + i, 1_001 + i) for i in range(40)]
    seen, real = [], components_module.checkpointed

    def counted(df):
        out = real(df)
        if out.columns[:2] == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(components_module, "checkpointed", counted)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs + chain, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(60), 0) | dict.fromkeys(range(1_000, 1_041), 1_000)
    assert seen[0] == 2 * len(pairs + chain) and len(seen) > 2
    assert max(seen[1:]) <= 2 * len(chain) and seen[-1] == 0


def test_links_of_a_group_are_not_handed_on_pair_by_pair(spark, monkeypatch):
    """40 near copies, each linked with each: the second call for components hears of each copy once."""
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*w[:i], f"x{i}", *w[i + 1 :]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "node long, _text string")
    every = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "u long, v long")
    sizes, real = [], near_copies.components

    def counted(edges):
        sizes.append(edges.count())
        return real(edges)

    monkeypatch.setattr(near_copies, "components", counted)
    got = {r.node: r.label for r in near_copies.near_components(docs, lambda _: every).collect()}
    assert got == dict.fromkeys(range(40), 0)
    assert sizes == [780, 39]
