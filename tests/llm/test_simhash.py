from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from corridor_jobs.llm import simhash
from tests.llm.edge_cases import documents, plain


def slow_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    u = np.array(sorted(set(fps)), dtype=np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3):
            up[find(int(u[i]))] = find(int(u[i + 1 + j]))
    return {f: find(f) for f in up}


def test_nearest_codewords():
    table = simhash.golay().astype(np.int64)
    assert (np.bincount(table, minlength=4096) == 2048).all()  # perfect: equal spheres fill the space
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 300)
    stored, sought = simhash._keys(np.concatenate([v, v ^ (1 << rng.integers(0, 23, 300))]).astype(np.int64))
    same = [set(sought[0][i][sought[0][i] >= 0]) for i in range(300)]
    assert all(len(s) in (1, 6) for s in same)


def test_texts(spark):
    docs = documents(spark, 30)
    fp = {i: slow_fingerprint(t) for i, t in plain(docs)}
    label = classes_of(fp.values())
    least = {}
    for i, f in fp.items():
        least[label[f]] = min(i, least.get(label[f], 1 << 60))
    got = simhash.classes(docs).collect()
    assert len(got) == docs.count()
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == least[label[fp[r.doc_id]]] for r in got)
    assert simhash.classes(docs.filter("false")).isEmpty()
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns and left.count() < docs.count()


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_equal_brute_force(spark, monkeypatch, crowd):
    """Chains and clusters of fingerprints at up to three bits; crowd=2 sends nearly all through the dense path."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                f ^= 1 << b
            if rng.random() < 0.5:
                f ^= 0
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame(pd.DataFrame({"fp": signed}))).collect()]
    mask = (1 << 64) - 1
    assert all(bin((u ^ v) & mask).count("1") <= 3 for u, v in edges)
    up = {f: f for f in fps}
    find = lambda x: x if up[x] == x else find(up[x])
    for u, v in edges:
        up[find(u & mask)] = find(v & mask)
    want = classes_of(fps)
    group = lambda of: sorted(sorted(f for f in fps if of(f) == k) for k in {of(f) for f in fps})
    assert group(find) == group(lambda f: want[f])
