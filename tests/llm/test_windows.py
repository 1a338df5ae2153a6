from __future__ import annotations

import hashlib
import random
import re

from corridor_jobs.llm import windows
from tests.llm.edge_cases import documents, plain


def brute(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, digest of the kept words) by a dictionary of all windows."""
    texts = {}
    for i, t in sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1])):
        texts.setdefault(i, re.findall(r"[^\x20\x09-\x0D]+", t))
    seen, out = set(), {}
    for i, ws in texts.items():
        gone = set()
        for j in range(len(ws) - size + 1):
            w = tuple(ws[j : j + size])
            if w in seen:
                gone.update(range(j, j + size))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out[i] = (i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((out[i] for i, _ in rows), key=str)


def found(df, **more) -> list[tuple]:
    got = windows.deduplicated(df, **more).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def test_equals_a_dictionary_of_all_windows(spark):
    df = documents(spark, ids=False)
    got = found(df)
    assert got == brute(plain(df), windows.SIZE)
    assert sum(r[2] for r in got) > 500 and any(0 < r[2] < r[1] for r in got)


def test_few_different_words_short_windows_and_slices(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    rows += [(900, "a " * 500), (901, "x y " * 300), (902, "a b 　 c\x1c " * 40)]  # other blanks are parts of words
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, size=6, k=3) == brute(rows, 6)
    assert found(df, size=6, k=6) == brute(rows, 6)  # one anchor a window
    monkeypatch.setattr(windows, "STEP", 64)
    texts = [t.encode() for _, t in rows]
    whole = {(t, a + j) for text, at, n, *_ in windows.runs_of(texts, 6, 3) for t, a, m in zip(text, at, n, strict=True) for j in range(m)}
    assert whole == {(t, j) for t, (_, body) in enumerate(rows) for j in range(len(re.findall(r"[^\x20\x09-\x0D]+", body)) - 5)}


def test_kept_words_and_intervals(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three\t{passage}\nfour"), (3, passage)], "doc_id long, text string")
    got = {r.doc_id: r for r in windows.deduplicated(df, kept_text=True).collect()}
    assert (got[1].n_removed, got[1].starts) == (0, [])
    assert (got[2].kept, got[2].starts, got[2].ends) == ("three four", [1], [31])
    assert (got[3].kept, got[3].n_removed) == ("", 30)


def test_empty_table(spark):
    assert windows.deduplicated(documents(spark).limit(0)).isEmpty()
