"""A small table of documents with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _text int, fp double"
WORDS = "the quick brown fox jumps over a lazy dog while rain falls on Ünter den Linden ça va niño".split()


def documents(spark, n: int = 60, seed: int = 1, ids: bool = True):
    """Copies, near copies, shared passages, nulls, empty and long texts, ties, and columns whose names clash."""
    rng = random.Random(seed)
    body = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(k))
    passage = body(60)
    rows = []
    for i in range(n):
        text = body(rng.randrange(1, 60)) + "\n" + body(20)
        if i % 5 == 1:
            text = rows[i - 1][1]
        elif i % 5 == 2:
            text = (rows[i - 1][1] or "").upper()
        elif i % 5 == 3:
            text = body(10) + " " + passage + "\n" + passage + "\nend"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0))
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", None, 0), (n + 2, " \t\n ", "en", "b", 3), (n + 3, body(20_000), "en", "c", 0), (n + 4, "word", None, "a", 4), (n + 5, "", "en", "a", 0)]
    rows.append(rows[3])  # a repeated row
    if not ids:
        rows.append((None, body(9), "en", "b", 0))
    return spark.createDataFrame([(*r, "x", 7, 0.5) for r in rows], SCHEMA)


def plain(df) -> list[tuple]:
    """(doc_id, text) with null texts as empty."""
    return [(r.doc_id, r.text or "") for r in df.collect()]
