from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from corridor_jobs.llm import pieces, registry
from tests.llm.edge_cases import documents
from tests.llm.test_exact_and_mixing import filled


def test_stages_keep_columns_and_run_takes_effect(spark, tmp_path):
    docs = documents(spark, 40).dropDuplicates(["doc_id"])
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    texts = {r.doc_id: (r.text or "") for r in now.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    assert len(seen[0]) == len(texts)  # nothing toxic
    last = {}
    for i, t in texts.items():
        last[t.encode().lower()] = max(i, last.get(t.encode().lower(), -1))
    assert seen[1] == set(last.values())
    assert seen[2] <= seen[1] and seen[3] <= seen[2] and seen[4] == seen[3]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == seen[4]
    r = final[0]
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.pieces)).encode()).hexdigest() and r.n_tokens == len(r.pieces)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], set[int]]:
    """Rows, and the ids of the toxic ones: copies, near copies, null and repeated ids, empty texts."""
    rng = random.Random(21)
    body = lambda n: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta', 'tree', 'house', 'river'])}{rng.randrange(400)}" for _ in range(n))
    rows, toxic = [], set()
    for i in range(300):
        text = body(60)
        if i % 6 == 0:
            words = text.split()
            for k in range(5, 55, 3):
                words[k] = rng.choice(["vilescum", "hatefool", "rotworm"])
            text, _ = " ".join(words), toxic.add(i)
        elif i % 6 == 2:
            text = rows[i - 1][1].upper()  # equal but for case
        elif i % 6 == 4:
            text = rows[i - 1][1] + " more"  # near
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", "b", 0), (None, body(80), "en", "a", 0), (5, body(90), "en", "c", 0), (7, body(70), "fr", "d", 0), (7, body(71), "fr", "d", 0)]
    return rows, toxic


def slow_run(rows: list[tuple]) -> Counter:
    """What the stages after the first make of the rows, without Spark: (doc_id, source, n_tokens, digests)."""
    import sentencepiece

    low = lambda t: (t or "").encode().lower()
    best = {}
    for i, text, *_ in rows:
        key = low(text)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    rows = [r for r in rows if (-1 if r[0] is None else r[0]) == best[low(r[1])]]

    def shingles(t):
        w = low(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))
    find = lambda k: k if up[k] == k else find(up[k])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    rows = [r for g in groups.values() for r in g if r[0] is None or r[0] == min(x[0] for x in g if x[0] is not None)]
    size = lambda r: len((r[1] or "").encode().split())
    own, sizes = defaultdict(list), Counter()
    for r in rows:
        own[r[3]].append(r)
        sizes[r[3]] += size(r)
    library, out = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), Counter()
    target = filled(sizes)
    for source, mine in own.items():
        at, quota = 0, int(target[source] + 0.5)
        order = sorted((r for r in mine if size(r)), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), size(r)))
        for r in order + [r for r in mine if not size(r)]:
            n = size(r)
            taken = sum(max(0, min(n, quota - at - turn * sizes[source])) for turn in range(3))
            ids = library.encode(r[1] or "")
            row = (r[0], source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
            if copies := int(taken / n + 0.5) if n else 1:
                out[row] += copies
            at += n
    return out


def test_run_equals_a_version_without_spark(spark, tmp_path):
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    clean = [r for r in rows if r[0] not in toxic]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r[:2] for r in clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    want = slow_run(clean)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100 and max(want.values()) > 1


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
