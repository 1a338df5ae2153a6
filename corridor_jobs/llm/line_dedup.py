"""Repeated runs of lines, by a suffix array over line-id sequences (native).

Equal texts are one sequence: all its rows but the first are copies from end to end. In the sequences of distinct texts,
a line that occurs once ends every run, so only suffixes that start with a repeated line are carried, each with the
number of lines to the next such end (reach). Prefix doubling ranks them: the rank by 2h lines follows from the rank by h
lines and that of the suffix h lines on. A suffix leaves the rounds once it is alone in its class or the class has seen
its whole reach, so each round holds fewer, and the rounds end by themselves. Class sizes are added up in two levels, so
that a line which a third of all lines equal is no single task.

The suffixes that entered the round of 2 ** k lines, by their ranks, tell which prefixes of 2 ** k lines are equal. With
them the common prefix of neighbours in the suffix array is found by binary descent, whatever its length. Neighbours with
a common prefix of min_lines or more form an interval: the first place of each stays, the lines of later places are
deleted. The longer of a suffix's two common prefixes is the longest run there that stands elsewhere too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, released, running_total, table, whole, written

MIN_LINES = 1
MOST_ROUNDS = 64
#: Levels joined in one job of the descent.
LEVELS_AT_ONCE = 3
#: What makes a line more than blank.
VISIBLE = r"[^\x20\x09-\x0D]"


def _width(rows: int) -> int:
    return max(1, int(rows**0.5))


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text, in two longs."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, h1, h2, first, copied, lines: each distinct text once, with its least doc_id (null is least), and if it has others.

    lines are those that are not blank: (at, end, a, b), where end is the place of the next one and (a, b) its 128-bit
    id. d rises with (first, h1, h2), so it also stands for the order of places.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))
    each = F.transform(F.split("_text", "\n"), lambda x, k: F.struct(k.alias("at"), x.rlike(VISIBLE).alias("some"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    rows = rows.select("doc_id", *_text_key(F.col("_text")), F.size(F.split("_text", "\n")).alias("_n"), F.filter(each, lambda x: x["some"]).alias("_lines"))
    until = lambda k: F.coalesce(F.try_element_at("_lines", k + 2)["at"], F.col("_n"))
    lines = F.transform("_lines", lambda x, k: F.struct(x["at"].alias("at"), until(k).alias("end"), x["a"].alias("a"), x["b"].alias("b")))
    rows = rows.select("h1", "h2", F.struct("doc_id").alias("id"), lines.alias("lines"))
    texts = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("lines").alias("lines"))
    texts = texts.select("h1", "h2", F.col("id.doc_id").alias("first"), (F.col("id") != F.col("last")).alias("copied"), "lines").orderBy(F.col("first").asc_nulls_first(), "h1", "h2")
    return written(texts.withColumn("d", F.monotonically_increasing_id()))


def suffixes(lines: DataFrame) -> DataFrame:
    """d, i, line, reach: the suffixes of the sequences (d, i, a, b; other columns are kept) that start with a repeated line.

    line is the number of repeated lines with a smaller id, reach the number of repeated lines from here to the next
    line that occurs once, or the end.
    """
    kinds = written(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    bits = 64 - max(1, min(24, _width(max(1, kinds.count())).bit_length()))
    kinds_ranked = kinds.withColumns({"_all": F.lit(0), "_bucket": F.shiftright("a", bits)})
    ranked = running_total(kinds_ranked, ["_all"], "_bucket", ["a", "b"], "n", "line").select("a", "b", "line")
    found = lines.join(ranked, ["a", "b"]).drop("a", "b")
    island = F.col("i") - F.row_number().over(Window.partitionBy("d").orderBy("i"))
    found = found.withColumn("_island", island)
    last = F.max("i").over(Window.partitionBy("d", "_island"))
    out = written(found.withColumn("reach", last - F.col("i") + 1).drop("_island"))
    discard(kinds)
    return out


def doubled(open_: DataFrame, ranks: DataFrame, h: int, width: int, round_: int) -> DataFrame:
    """The suffixes of open_ (d, i, line, reach, rank) with their rank by 2h lines, the round, and if they stay open.

    ranks (d, i, rank) has all suffixes. One that ends before comes first.
    """
    further = ranks.select("d", (F.col("i") - h).alias("i"), F.col("rank").alias("_next"))
    next_rank = F.when(F.col("reach") > h, F.col("_next")).otherwise(-1)
    pairs = written(open_.join(further, ["d", "i"], "left").select("d", "i", "line", "reach", "rank", next_rank.alias("_next")))
    sizes = pairs.groupBy("rank", "_next").agg(F.count(F.lit(1)).alias("n")).withColumn("_bucket", F.floor(F.col("_next") / width))
    placed = running_total(sizes, ["rank"], "_bucket", ["_next"], "n", "_less").select("rank", "_next", "_less", "n")
    open_still = (F.col("n") > 1) & (F.col("reach") >= 2 * h)
    new = pairs.join(placed, ["rank", "_next"]).select("d", "i", "line", "reach", (F.col("rank") + F.col("_less")).alias("rank"), open_still.alias("open"), F.lit(round_).alias("round"))
    out = written(new)
    discard(pairs)
    return out


def suffix_array(found: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Ranks (d, i, line, reach, rank) of all suffixes, equal ones sharing one; the levels, the k-th being the suffixes
    that have 2 ** k lines which also start elsewhere, with their ranks by so many; and the tables behind both."""
    spark, columns = found.sparkSession, ["d", "i", "line", "reach", "rank"]
    open_ = found.withColumn("rank", F.col("line")).select(columns)
    width = _width(max(1, found.count()))
    ranks, levels, tables = open_, [], []
    for k in range(MOST_ROUNDS):
        levels.append(open_)
        if open_.isEmpty():
            return ranks, levels, tables
        tables.append(doubled(open_, ranks, 1 << k, width, k))
        every = spark.read.schema(tables[0].schema).parquet(*(t.written_path for t in tables))
        ranks = every.filter((F.col("round") == k) | ~F.col("open")).select(columns)
        open_ = tables[-1].filter("open").select(columns)
        released(spark)
    raise RuntimeError(f"suffixes were not told apart in {MOST_ROUNDS} rounds")


def prefixes(ranks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rank, n, _bucket, lcp (lines shared with the class before), own (lines shared within the class, 0 if it is alone)."""
    width = _width(max(1, ranks.count()))
    classes = ranks.groupBy("rank").agg(F.min(F.struct("line", "d", "i")).alias("p"), F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n"))
    classes = classes.select("rank", "n", "p", F.when(F.col("n") > 1, F.col("reach")).otherwise(0).alias("own"), F.floor(F.col("rank") / width).alias("_bucket"))
    # The class before: in the same bucket, or the last of the nearest earlier bucket.
    ends = classes.groupBy("_bucket").agg(F.max(F.struct("rank", "p")).alias("_end"))
    ends = ends.select("_bucket", F.lag("_end").over(Window.orderBy("_bucket")).alias("_before"))
    near = F.lag(F.struct("rank", "p")).over(Window.partitionBy("_bucket").orderBy("rank"))
    all_ = classes.withColumn("_near", near).join(ends, "_bucket").withColumn("_near", F.coalesce("_near", "_before"))
    all_ = written(all_.select("rank", "n", "own", "_bucket", "p.line", "p.d", "p.i", F.col("_near.p.line").alias("_line"), F.col("_near.p.d").alias("_d"), F.col("_near.p.i").alias("_i")))
    both = all_.filter("line = _line").select("rank", "d", "i", "_d", "_i", F.lit(0).alias("lcp"))
    step = None
    for k in reversed(range(len(levels))):
        a = levels[k].select("d", F.col("i").alias("_p"), F.col("rank").alias("_ra"))
        b = levels[k].select(F.col("d").alias("_d"), F.col("i").alias("_q"), F.col("rank").alias("_rb"))
        both = both.withColumns({"_p": F.col("i") + F.col("lcp"), "_q": F.col("_i") + F.col("lcp")})
        both = both.join(a, ["d", "_p"], "left").join(b, ["_d", "_q"], "left")
        both = both.withColumn("lcp", F.col("lcp") + F.when(F.col("_ra") == F.col("_rb"), 1 << k).otherwise(0)).drop("_p", "_q", "_ra", "_rb")
        if k % LEVELS_AT_ONCE == 0 and k:  # plans stay small
            before, both = step, written(both)
            step = both
            discard(*([before] if before else []))
            released(ranks.sparkSession)
    out = written(all_.select("rank", "n", "own", "_bucket").join(both.select("rank", "lcp"), "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0))))
    discard(all_, *([step] if step else []))
    return out


def intervals(ranks: DataFrame, classes: DataFrame, min_lines: int) -> DataFrame:
    """d, i, reach, longest (the longest run here that also starts elsewhere), interval (shared by the suffixes with the
    same min_lines first lines) for every suffix."""
    opened = classes.withColumns({"_new": F.when(F.col("lcp") >= min_lines, 0).otherwise(1), "_all": F.lit(0)})
    opened = running_total(opened, ["_all"], "_bucket", ["rank"], "_new", "_opened")
    after = F.coalesce(F.lead("lcp").over(Window.partitionBy("_bucket").orderBy("rank")), F.col("_after"), F.lit(0))
    starts = classes.groupBy("_bucket").agg(F.min(F.struct("rank", "lcp")).alias("_start"))
    starts = starts.select("_bucket", F.lead("_start.lcp").over(Window.orderBy("_bucket")).alias("_after"))
    opened = opened.join(starts, "_bucket").withColumn("longest", F.greatest("own", "lcp", after))
    placed = opened.select("rank", "longest", (F.col("_opened") + F.col("_new")).alias("interval"))
    return ranks.join(placed, "rank").select("d", "i", "reach", "longest", "interval")


def runs(lines: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """For sequences (d, i, a, b, and columns to keep): the suffixes that start with a repeated line, with their longest
    run, and those (d, i) at which min_lines lines start that also start earlier, in a lesser d or further up."""
    found = suffixes(lines)
    ranks, levels, tables = suffix_array(found)
    released(lines.sparkSession)
    classes = prefixes(ranks, levels)
    placed = written(intervals(ranks, classes, min_lines))
    discard(classes, *tables)
    released(lines.sparkSession)
    many = placed.filter(F.col("reach") >= min_lines)
    first = many.groupBy("interval").agg(F.min(F.struct("d", "i")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = many.join(first, "interval").filter(F.struct("d", "i") != F.col("_first")).select("d", "i")
    kept = [c for c in found.columns if c not in ("line", "reach")]
    return found.select(kept).join(placed.select("d", "i", "longest"), ["d", "i"]), later


def verdicts(texts: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """h1, h2, first, lead, n, copied, gone, longest for the texts (see sequences) that share a run of lines or have copies.

    gone are the deleted stretches of lines (at, end) of its first row; lead the number of blank lines before the first
    other; n the number of lines that are not blank.
    """
    lines = texts.select("d", F.posexplode("lines").alias("i", "l")).select("d", "i", "l.*")
    placed, later = runs(lines, min_lines)
    covered = later if min_lines == 1 else later.select("d", F.explode(F.sequence(F.col("i"), F.col("i") + min_lines - 1)).alias("i")).distinct()
    told = placed.join(covered.withColumn("_gone", F.lit(True)), ["d", "i"], "left")
    spot = F.when(F.col("_gone"), F.struct("at", "end"))
    told = told.groupBy("d").agg(F.max("longest").alias("longest"), F.array_sort(F.collect_list(spot)).alias("gone"))
    every = texts.select("d", "h1", "h2", "first", "copied", F.size("lines").alias("n"), F.coalesce(F.try_element_at("lines", F.lit(1))["at"], F.lit(0)).alias("lead"))
    every = every.filter("n > 0").join(told, "d", "left").filter("copied OR longest IS NOT NULL")
    return written(every.drop("d"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, kept (the text without the deleted lines); a row per input row.

    Lines are what line feeds divide. Runs are of lines that are not blank (see VISIBLE), blank ones between them being
    passed over; a blank line shares the fate of the last other line above it. Of equal runs the one in the least doc_id
    stays (null ids first), within a document the upper one; rows that share an id are taken in order of a hash of
    their text, and rows that repeat both are one place and share what they keep. Overlapping copies are judged on the
    input. n_runs counts stretches of deleted lines; longest_run is the length, without blank lines, of the longest run
    of the document that stands elsewhere too. Empty or null text has no lines. Extra columns are ignored. Very long
    documents are rows like any other: their lines are spread over tasks, and come together again in one row. An empty
    table gives no rows.
    """
    texts = sequences(docs, id_col, text_col)
    told = verdicts(texts, min_lines)
    discard(texts)
    released(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))
    rows = rows.select("doc_id", "_text", *_text_key(F.col("_text"))).join(told, ["h1", "h2"], "left").withColumn("_cut", F.split("_text", "\n"))
    copy = F.col("copied") & ~F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n") >= min_lines)
    stretch = lambda g: F.sequence(g["at"], g["end"] - 1)
    gone = F.when(copy, F.sequence(F.col("lead"), F.size("_cut") - 1)).when(F.size("gone") > 0, F.flatten(F.transform("gone", stretch)))
    rows = rows.withColumn("_gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), "_gone")
    starts = F.filter("_gone", lambda x, k: (k == 0) | (F.try_element_at("_gone", k) != x - 1))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    size = lambda c: F.when(F.col("_gone").isNotNull(), F.size(c))
    return rows.select(
        "doc_id",
        F.when(F.col("_text") == "", 0).otherwise(F.size("_cut")).cast("long").alias("n_lines"),
        count(size("_gone")).alias("n_removed"),
        count(size(starts)).alias("n_runs"),
        count(F.when(F.col("copied"), F.col("n")).otherwise(F.col("longest"))).alias("longest_run"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda k: F.element_at("_cut", k + 1)), "\n")).alias("kept"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", kept)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i, lines[i] AS line, regexp_matches(lines[i], '[^\x20\x09-\x0D]') AS visible
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE body <> '')
), v AS (
  SELECT doc_id, i, md5(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone
  FROM l WHERE visible
), r AS (
  SELECT doc_id, k, line AS name, 1 AS run FROM v QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT doc_id, k, name, run FROM (
    SELECT r.doc_id, r.k, md5(r.name || v.line) AS name, r.run + 1 AS run, count(*) OVER (PARTITION BY md5(r.name || v.line)) AS places
    FROM r JOIN v ON v.doc_id = r.doc_id AND v.k = r.k + r.run
  ) WHERE places > 1
), g AS (
  SELECT doc_id, max(run) AS longest_run FROM r GROUP BY doc_id
), f AS (
  SELECT l.doc_id, l.i, l.line,
         coalesce(last_value(v.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS gone
  FROM l LEFT JOIN v ON l.doc_id = v.doc_id AND l.i = v.i
), m AS (
  SELECT doc_id, i, line, gone, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS gone_before FROM f
), a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         count(*) FILTER (WHERE gone AND NOT gone_before) AS n_runs,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_runs, 0) AS n_runs,
       CAST(coalesce(g.longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
