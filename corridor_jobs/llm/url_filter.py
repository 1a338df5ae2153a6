"""URL verdicts: rules first, then naive Bayes over segmented host and path tokens.

Host labels are concatenated words. Their segmentation is the most likely one under a unigram model counted on all pages
(visible text, and path tokens); each distinct label is split once by Viterbi. URLs that a rule decides label the rest:
multinomial naive Bayes over words of host and path gives the verdict where no rule fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (host and path prefix, verdict). A rule fits its host and all subdomains; the longest that fits wins.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: No label of a host is longer (DNS), so no word of one is.
LONGEST_WORD = 63
#: Labels are cut into parts of so many letters, each with the start of the next, before their substrings are listed.
PART = 512
SMOOTHING = 1.0
UNKNOWN = 1e-3  # the count of a word that no page has, times 10 ** -(letters beyond the first)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(there > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, kind in sorted(RULES, key=lambda r: len(r[0])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict)."""
    host, path = url_parts(F.col("_url"))
    parts = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n: letters-only words of all pages' visible text and paths, up to LONGEST_WORD letters (longer ones cannot
    be part of a host's label)."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    _, path = url_parts(F.col("_url"))
    each = pages.select(shown.alias("_shown"), F.col("url").alias("_url")).select(F.explode(F.concat(words_of(F.col("_shown")), words_of(F.coalesce(path, F.lit(""))))).alias("word"))
    return each.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most likely split; of equals the one with the longer last word."""
    n = len(label)
    best, back = np.full(n + 1, -np.inf), [0] * (n + 1)
    best[0] = 0.0
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            count = known.get((start, end), UNKNOWN * 10.0 ** (start + 1 - end))
            p = best[start] + float(np.log(count / total))
            if p > best[end]:
                best[end], back[end] = p, start
    out: list[str] = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words: every distinct label split. Substrings meet their counts by join; no model is sent to executors.
    Work and rows grow with a label's length, not with its square."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    labels = written(labels.select("label").distinct().withColumn("_id", F.monotonically_increasing_id()))
    parts = F.transform(F.sequence(F.lit(0), F.length("label") - 1, F.lit(PART)), lambda c: F.struct(c.alias("c"), F.substring(F.col("label"), c + 1, F.lit(PART + LONGEST_WORD - 1)).alias("part")))
    spans = labels.select("_id", F.inline(parts))  # from here on without the label, whose length would multiply with its rows
    spans = spans.select("_id", "c", "part", F.explode(F.sequence(F.lit(0), F.least(F.length("part"), F.lit(PART)) - 1)).alias("s"))
    spans = spans.select("_id", (F.col("c") + F.col("s")).alias("start"), F.substring(F.col("part"), F.col("s") + 1, F.lit(LONGEST_WORD)).alias("part"))
    spans = spans.select("_id", "start", "part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("k"))
    spans = spans.select("_id", "start", (F.col("start") + F.col("k")).alias("end"), F.substring(F.col("part"), F.lit(1), F.col("k")).alias("word"))
    found = spans.join(counts, "word").groupBy("_id").agg(F.collect_list(F.struct("start", "end", "n")).alias("known"))  # at most LONGEST_WORD x length
    rows = labels.join(found, "_id", "left").drop("_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [
                viterbi(label, {(k["start"], k["end"]): float(k["n"]) for k in (known if known is not None else ())}, float(total))
                for label, known in zip(pdf["label"], pdf["known"], strict=True)
            ]
            yield pd.DataFrame({"label": pdf["label"], "words": split})

    return rows.mapInPandas(run, "label string, words array<string>")


def tokens(urls: DataFrame, split: DataFrame) -> DataFrame:
    """host, path, token for every distinct url: h: and a word of a host label, p: and a word or number length of a path."""
    keys = urls.select("host", "path").distinct()
    hosts = keys.select("host").distinct().select("host", F.explode(F.split("host", r"\.")).alias("label"))
    host = hosts.join(split, "label", "left").select("host", F.explode(F.coalesce("words", F.array("label"))).alias("word"))
    host = host.filter("word <> ''").groupBy("host").agg(F.array_sort(F.collect_list(F.concat(F.lit("h:"), "word"))).alias("_host"))
    number = F.transform(F.regexp_extract_all("path", F.lit(r"[0-9]+"), F.lit(0)), lambda d: F.concat(F.lit("p#"), F.length(d).cast("string")))
    path = F.concat(F.transform(words_of(F.col("path")), lambda w: F.concat(F.lit("p:"), w)), number)
    both = keys.join(host, "host", "left")
    return both.select("host", "path", F.concat(F.coalesce("_host", F.array().cast("array<string>")), path).alias("tokens"))


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block; null where a rule decides).

    One row per page; an empty table gives no rows, other columns are ignored. Long urls are judged whole; labels beyond
    what a host can have are split into words of LONGEST_WORD letters at most. A url without tokens has the prior's verdict. Without urls that a rule decides, everything is allowed. Null page_ids
    and repeated rows are judged like any other. Hot hosts and tokens cost little: urls are counted once each with the
    number of their pages, words of a host once per host.
    """
    rows = written(judged(pages))
    counts = unigrams(pages)
    labels = rows.select("host").distinct().select(F.explode(F.split("host", r"\.")).alias("label")).filter("label <> ''").distinct()
    split = written(segmented(labels, written(counts)))
    urls = rows.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("pages"))
    listed = written(urls.join(tokens(rows, split), ["host", "path"]))
    each = listed.filter("ruled IS NOT NULL").select(F.explode("tokens").alias("token"), "ruled", "pages")
    n = lambda kind: F.sum(F.when(F.col("ruled") == kind, F.col("pages")).otherwise(0))
    model = written(each.groupBy("token").agg(n("block").alias("block"), n("allow").alias("allow")))
    seen = listed.filter("ruled IS NOT NULL").agg(n("block"), n("allow")).first()
    sums = model.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    block, allow, size = (float(x or 0) for x in sums)
    prior = float(np.log(((seen[0] or 0) + SMOOTHING) / ((seen[1] or 0) + SMOOTHING)))
    if not seen[0] and not seen[1]:
        prior = -1.0
    top, bottom = block + SMOOTHING * (size + 1), allow + SMOOTHING * (size + 1)
    odds = F.log((F.coalesce("block", F.lit(0)) + SMOOTHING) / top) - F.log((F.coalesce("allow", F.lit(0)) + SMOOTHING) / bottom)
    open_urls = listed.filter("ruled IS NULL").select("host", "path", "tokens")
    scored = (
        open_urls.select("host", "path", F.explode("tokens").alias("token"))
        .join(model, "token", "left")
        .groupBy("host", "path")
        .agg(F.round(F.sum(odds), 9).alias("_odds"))
    )
    judged_urls = open_urls.select("host", "path").join(scored, ["host", "path"], "left")
    judged_urls = judged_urls.select("host", "path", (F.coalesce("_odds", F.lit(0.0)) + prior).alias("score"))
    return rows.join(judged_urls, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))
