from __future__ import annotations

import itertools

import numpy as np
import pytest

from corridor_jobs.llm import toxicity, url_filter
from tests.llm.edge_cases import documents


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    e, step, start = rng.normal(size=6) * 2, rng.normal(size=(2, 2)), 0.4
    weight = np.zeros((6, 2))
    for path in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(x * s for x, s in zip(e, path, strict=True)) + start * path[0] + sum(step[a, b] for a, b in itertools.pairwise(path)))
        for i, s in enumerate(path):
            weight[i, s] += w
    want = weight[:, 1] / weight.sum(axis=1)
    assert toxicity.chain_marginals(e, np.array([6]), start, step) == pytest.approx(want)


def test_long_chains_equal_the_logarithmic_form():
    rng = np.random.default_rng(0)
    size = np.array([1, 5, 64, 65, 200, 0, 130])
    e, step = rng.normal(size=size.sum()) * 3, rng.normal(size=(2, 2))
    grid, mask = np.zeros((7, 200)), np.zeros((7, 200))
    at = 0
    for i, n in enumerate(size):
        grid[i, :n], mask[i, :n] = e[at : at + n], 1
        at += n
    want = toxicity._marginals(grid, mask, 0.3, step)[0][mask > 0]
    assert toxicity.chain_marginals(e, size, 0.3, step) == pytest.approx(want)


def test_chains_with_large_numbers_equal_all_paths():
    """Nothing is clipped: emissions and steps that scaled products cannot hold are taken in logarithms."""

    def slow(e, start, step):
        score = np.array([sum(x * s for x, s in zip(e, p, strict=True)) + start * p[0] + sum(step[a][b] for a, b in itertools.pairwise(p)) for p in itertools.product((0, 1), repeat=len(e))])
        on = np.array(list(itertools.product((0, 1), repeat=len(e))), dtype=bool)
        return [np.exp(np.logaddexp.reduce(score[on[:, i]]) - np.logaddexp.reduce(score)) for i in range(len(e))]

    rng = np.random.default_rng(9)
    cases = [(np.array([45.0, -45.0, 2.0]), 0.0, [[0.0, -40.0], [-40.0, 0.0]]), (np.array([45.0, -45.0, 2.0]), 0.0, [[-40.0] * 2] * 2), (np.array([800.0, -900.0, 99.0, 3.0]), 1.0, [[0.0, -5.0], [-6.0, 1.0]])]
    cases += [(rng.normal(size=10) * k, 0.2, (rng.normal(size=(2, 2)) * k).tolist()) for k in (3, 30, 200, 900)]
    for e, start, step in cases:
        both = np.concatenate([e, [0.3, -0.2]])  # with a chain that needs nothing
        got = toxicity.chain_marginals(both, np.array([len(e), 2]), start, np.array(step))
        assert got == pytest.approx([*slow(e, start, step), *slow([0.3, -0.2], start, step)], abs=1e-9)
    there, back = np.full(70, 240.0), np.full(70, -240.0)  # scaled products vanish half way, and come back
    e, step = np.concatenate([there, back, [1.0]]), np.array([[0.0, -250.0 + 1], [-250.0 + 1, 0.0]])
    want = toxicity._marginals(e[None], np.ones((1, len(e))), 0.0, step)[0][0]
    assert toxicity.chain_marginals(e, np.array([len(e)]), 0.0, step) == pytest.approx(want, abs=1e-9)


def test_field_is_at_the_top_of_its_likelihood():
    """At the end of a long fit the slope of the likelihood, summed over all paths, is flat in every chain weight."""
    sample = [(["a", "b", "c"], [0, 1, 1]), (["c", "a"], [1, 0]), (["b", "b", "a", "c"], [0, 1, 0, 0]), (["c"], [0])]
    decay = 0.02
    crf = toxicity.fit_field({"c": 3}, sample, rounds=1500, rate=0.02, decay=decay)

    def objective(start, step, shift):
        total = 0.0
        for tokens, marks in sample:
            e = [crf.emission(t) + shift * (t == "b") for t in tokens]
            def score(path):
                return start * path[0] + sum(x * y for x, y in zip(e, path, strict=True)) + sum(step[i, j] for i, j in itertools.pairwise(path))
            total += score(marks) - np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=len(tokens))])
        return total / len(sample) - decay / 2 * (start**2 + (step**2).sum())

    def slope(f):
        return (f(1e-5) - f(-1e-5)) / 2e-5

    assert slope(lambda d: objective(crf.start + d, crf.step, 0)) == pytest.approx(0, abs=2e-3)
    for i, j in itertools.product((0, 1), repeat=2):
        one = np.zeros((2, 2))
        one[i, j] = 1
        assert slope(lambda d, one=one: objective(crf.start, crf.step + d * one, 0)) == pytest.approx(0, abs=2e-3)
    own = crf.weights[crf.features("b")[0]]  # the feature of the form "b" alone
    assert slope(lambda d: objective(crf.start, crf.step, d)) == pytest.approx(decay * own, abs=2e-3)


def test_logistic_is_at_the_top_of_its_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5] + 0.3)))).astype(float)
    w = toxicity.fit_logistic(x, y, decay=1e-3)
    wide = np.column_stack([x, np.ones(200)])
    assert wide.T @ (y - 1 / (1 + np.exp(-wide @ w))) == pytest.approx(1e-3 * 200**0.5 * w, abs=1e-6)


def test_unseen_documents_are_told_apart(spark):
    """Held-out documents of sf0.1 (sf0.01 has six toxic ones): the share put right, and of pairs that the score orders."""
    here = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{here}/labels.parquet").select("doc_id", "toxic")
    got = labels.join(toxicity.op2_toxicity(spark, here), "doc_id").filter("held_out").toPandas()
    toxic, clean = (got[got.toxic == y].score.to_numpy() for y in (1, 0))
    above = (toxic[:, None] > clean[None, :]).mean() + (toxic[:, None] == clean[None, :]).mean() / 2
    assert len(toxic) > 50 and above > 0.92
    assert (got.predicted == got.toxic).mean() > 0.97


def test_toxic_words_are_learnt_and_found(spark):
    rows = [(i, f"plain words number {i} and " + ("you awful wretch there" if i % 4 == 0 else "a fine day it is")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(400, None), (401, ""), (None, "awful wretch"), (400, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == 404
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    hit = next(r for r in got if r.doc_id == 4)
    text = rows[4][1]
    found = {text[a:b] for a, b in zip(hit.starts, hit.ends, strict=True)}
    assert found & {"awful", "wretch"}
    assert {r.predicted for r in got if r.doc_id in (400, 401)} == {0}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 303  # the toxic row without an id goes too


def test_training_windows_cover_whole_texts(spark):
    told = " ".join(f"w{i}" for i in range(200)) + " Awful"
    train = spark.createDataFrame([(told, 1, 5), ("fine day awful so " * 50, 0, 6), ("", 0, 7), ("no mark here", 1, 8)], "_text string, toxic int, _at int")
    got = toxicity.windows(train, {"awful": 3}).collect()
    (marked,) = [r for r in got if r.marked]
    assert marked.tokens == [f"w{i}" for i in range(192, 200)] + ["awful"] and marked.marks == [0] * 8 + [1]
    clean = [r for r in got if not r.marked]
    assert sorted(len(r.tokens) for r in clean) == [8, 64, 64, 64] and not any(any(r.marks) for r in clean)
    assert len(toxicity.windows(train.repartition(1), {"awful": 3}, most=2).filter("not marked").collect()) == 2


def test_no_labels_and_no_documents(spark):
    docs = documents(spark, 10)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scores(docs, labels).collect()} == {0}
    assert toxicity.scores(docs.filter("false"), labels).isEmpty()


def test_rules(spark):
    urls = [
        ("http://X.Example.ORG/es/1?q#f", "x.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.org/en/1", "a.org", "/en/1", "org/", "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("https://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
        ("https://b.com/FR/x", "b.com", "/FR/x", None, None),
        ("https://org", "org", "", None, None),
        ("no scheme/org/", "", "", None, None),
        ("://", "", "", None, None),
        (None, "", "", None, None),
        ("a://h#x://y/z?", "h", "", None, None),
    ]
    rows = [(i, u[0], "<p>alpha beta</p>", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.verdicts(pages).collect()}
    assert len(got) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")


def slow_split(label, counts, total):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(label) - 1):
        words, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                words.append(label[at:i])
                at = i
        p = sum(np.log(counts.get(w, url_filter.UNKNOWN * 10.0 ** (1 - len(w))) / total) for w in words)
        if best is None or p > best[0] + 1e-12:
            best = p, words
    return best[0]


def test_segmentation_is_the_most_likely_one(spark):
    counts = {"the": 50, "tea": 9, "house": 20, "teahouse": 1, "a": 30, "at": 12, "ho": 1, "use": 7}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    labels = ["theteahouse", "ateahouse", "zqthe", "the"]
    got = {r.label: r.words for r in url_filter.segmented(spark.createDataFrame([(x,) for x in labels], "label string"), table).collect()}
    total = sum(counts.values())
    for x in labels:
        assert "".join(got[x]) == x
        p = sum(np.log(counts.get(w, url_filter.UNKNOWN * 10.0 ** (1 - len(w))) / total) for w in got[x])
        assert p == pytest.approx(slow_split(x, counts, total))
    assert got["theteahouse"] == ["the", "tea", "house"]


def test_labels_of_any_length(spark):
    """Rows and time grow with the length; substrings across the parts of a label are found."""
    counts = {"open": 40, "source": 30, "news": 50, "so": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    long = "opensourcenews" * 7200
    middle = "open" * 127 + "ope" + "source" * 90  # a word over the first cut
    got = {r.label: r.words for r in url_filter.segmented(spark.createDataFrame([(long,), (middle,), ("news",)], "label string"), table).collect()}
    assert len(long) > 100_000 and got[long] == ["open", "source", "news"] * 7200 and got["news"] == ["news"]
    total = float(sum(counts.values()))
    assert got[middle] == url_filter.viterbi(middle, {(a, a + len(w)): float(n) for w, n in counts.items() for a in range(len(middle)) if middle.startswith(w, a)}, total)


def test_bayes_equals_counts_by_hand(spark):
    rows = [(i, f"https://x.org/good/{'nice' * (i % 2)}", None) for i in range(6)] + [(9, "https://y.com/de/bad", None), (10, "https://y.com/it/bad", None), (11, "https://y.com/it/good", None)]
    got = {r.page_id: (r.verdict, r.score) for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0][1] is None and got[10][1] > got[11][1]
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_hosts_do_not_vouch_for_their_own_labels(spark):
    """A concatenated label with many pages is split into the words that texts and paths show."""
    text = "<p>green garden green house garden house</p>"
    rows = [(i, f"https://greengarden.net/house/{i}", text) for i in range(40)] + [(99, "HTTPS://greenhouse.net?x=1", text)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = {r.word: r.n for r in url_filter.unigrams(pages).collect()}
    assert counts == {"green": 82, "garden": 82, "house": 122}
    labels = spark.createDataFrame([("greengarden",), ("greenhouse",)], "label string")
    got = {r.label: r.words for r in url_filter.segmented(labels, url_filter.unigrams(pages)).collect()}
    assert got == {"greengarden": ["green", "garden"], "greenhouse": ["green", "house"]}
    judged = url_filter.judged(pages)
    listed = {t for r in url_filter.tokens(judged, url_filter.segmented(labels, url_filter.unigrams(pages))).collect() for t in r.tokens}
    assert {"h:green", "h:garden", "h:house"} <= listed and "h:greengarden" not in listed
    assert url_filter.verdicts(pages).count() == len(rows)


def test_verdicts_equal_slow_bayes(spark):
    """Scores and verdicts against plain counts over the same pages, words split by trying all cuts."""
    import math
    import re
    from collections import Counter

    shown = "<p>red garden shop news daily red shop</p>"
    hosts = ["redshop.com", "dailynews.com", "a.gardennews.net", "shop.org", "b.example.org", "redgarden.net"]
    paths = ["/de/shop/12", "/fr/news", "/en/1/red", "/it/garden/7", "", "/de/red?q=1", "/fr/garden#x"]
    rows = [(i, f"https://{hosts[i * 5 % 6]}{paths[i * 3 % 7]}", shown if i % 2 else None) for i in range(90)]
    rows += [(100, None, shown), (101, "no scheme", None), (102, "https://" + "redgarden" * 8 + ".net/it/" + "x" * 90, None), (102, "https://redshop.com/de/", None)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, label int")

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        return host.lower(), path

    def rule(host, path):
        fits = [(len(r), k) for r, k in url_filter.RULES for at, start in [r.split("/", 1)] if (host == at or host.endswith("." + at)) and path.startswith("/" + start)]
        return max(fits)[1] if fits else None

    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = Counter()
    for _, url, html in rows:
        counts.update(w for w in words(re.sub(r"<[^>]*>", " ", html or "")) + words(parts(url)[1]) if len(w) <= url_filter.LONGEST_WORD)
    total = sum(counts.values())
    split = {x: url_filter.viterbi(x, {(a, b): float(counts[x[a:b]]) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if x[a:b] in counts}, total) for _, u, _ in rows for x in parts(u)[0].split(".") if x}

    def tokens(host, path):
        return [f"h:{w}" for x in host.split(".") if x for w in split[x]] + [f"p:{w}" for w in words(path)] + [f"p#{len(d)}" for d in re.findall("[0-9]+", path)]

    seen, kinds = {"block": Counter(), "allow": Counter()}, Counter()
    for _, url, _ in rows:
        if verdict := rule(*parts(url)):
            seen[verdict].update(tokens(*parts(url)))
            kinds[verdict] += 1
    size = len(seen["block"].keys() | seen["allow"].keys())
    chance = lambda k, t: (seen[k][t] + 1) / (sum(seen[k].values()) + size + 1)
    want = []
    for i, url, _ in rows:
        verdict, score = rule(*parts(url)), None
        if verdict is None:
            score = math.log((kinds["block"] + 1) / (kinds["allow"] + 1)) + sum(math.log(chance("block", t) / chance("allow", t)) for t in tokens(*parts(url)))
            verdict = "block" if score > 0 else "allow"
        want.append((i, *parts(url), verdict, score))
    got = sorted((r.page_id, r.host, r.path, r.verdict, r.score) for r in url_filter.verdicts(pages).collect())
    want.sort()
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == pytest.approx(w[4], abs=1e-6) for g, w in zip(got, want, strict=True) if w[4] is not None)
    assert {"block", "allow"} <= {g[3] for g in got if g[4] is not None}
