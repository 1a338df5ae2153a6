"""Mixing sources to target weights by a low-discrepancy schedule of source slots (native).

A source's quota is its target in whole words: so many blocks of equal size, the last of which may be a part. The schedule
has a slot for each block of all sources. Slots whose points fall to a source beyond its quota go to the blocks that their
own source's share left without one, so that a source of a few words among millions has its words too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, running_total, table, whole, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 256
#: Shares of [0, 1) and points meet by equi-join on one of so many cells.
CELLS = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> source, source_size, target, quota (whole words), and the bounds low, high of its share of
    [0, 1).

    Weights 5, 2, 1 repeat over the sources in code-point order, null last. A target is min(3 x size, lambda x weight)
    with the lambda that makes the targets add up to all sizes; sorted by 3 x size / weight, the sources at their limit
    are a prefix, found with running sums. The frame has one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.when(place == 0, WEIGHTS[0]).when(place == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    fill = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        sizes.withColumn("_weight", weight.cast("long"))
        .withColumn("_most", F.col("source_size") * MAX_REPEATS)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_spent", F.coalesce(F.sum("_most").over(before), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_full", F.col("_most") * F.col("_left") <= (F.col("_total") - F.col("_spent")) * F.col("_weight"))
        .withColumn("_free", F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_most")).otherwise(0)).over(everything))
        .withColumn("_free_weight", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(
                F.col("_free").cast("double") * F.col("_weight") / F.greatest(F.col("_free_weight"), F.lit(1))
            ),
        )
    )
    sofar = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.col("_total"), F.lit(1)).cast("double")
    last = F.row_number().over(by_name) == F.count(F.lit(1)).over(everything)
    return (
        w.withColumn("_sofar", sofar)
        .withColumn("_last", last)
        .select(
            "source",
            "source_size",
            "target",
            F.floor(F.col("target") + 0.5).cast("long").alias("quota"),
            ((F.col("_sofar") - F.col("target")) / total).alias("low"),
            F.when(F.col("_last"), 2.0).otherwise(F.col("_sofar") / total).alias("high"),
        )
    )


def slot_points(spark: SparkSession, slots: int) -> DataFrame:
    """slot, point: the van der Corput point of each slot, its bits reversed after the binary point."""
    bits = max(1, (slots - 1).bit_length())
    flipped = F.reverse(F.lpad(F.bin("id"), bits, "0"))
    return spark.range(slots).select(
        F.col("id").alias("slot"), (F.conv(flipped, 2, 10).cast("double") / F.lit(float(1 << bits))).alias("point")
    )


def schedule(spark: SparkSession, quotas: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """_src, _no, block, slot: every block of every source (_src, _no, quota, low, high) and its slot.

    A slot's van der Corput point falls in one source's share of [0, 1), and its rank among the slots of that source is the
    number of the block. Of a share's slots no more count than the source has blocks. The others, few as the points are
    even, go in their order to the blocks without a slot. Ranks are two-level running totals.
    """
    wanted = quotas.withColumn("_blocks", F.ceil(F.col("quota") / block_words))
    slots = wanted.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    wide = max(1, int(max(1, slots) ** 0.5))
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * CELLS))
    shares = wanted.filter("high > low").select("_src", "_no", "low", "high", "_blocks", F.explode(cells).alias("_cell"))
    points = (
        slot_points(spark, slots)
        .withColumn("_cell", F.floor(F.col("point") * CELLS))
        .join(shares, "_cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    )
    points = points.select("_src", "_no", "_blocks", "slot", F.floor(F.col("slot") / wide).alias("_bucket"), F.lit(1).alias("_one"))
    ranked = written(running_total(points, ["_src", "_no"], "_bucket", ["slot"], "_one", "block").select("_src", "_no", "_blocks", "block", "slot"))
    own = ranked.filter("block < _blocks").select("_src", "_no", "block", "slot")
    have = own.groupBy("_src", "_no").agg(F.count(F.lit(1)).alias("_have"))
    short = wanted.join(have, ["_src", "_no"], "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_blocks > _have")
    lacking = short.select("_src", "_no", F.explode(F.sequence("_have", F.col("_blocks") - 1)).alias("block"))
    free = ranked.filter("block >= _blocks").select("slot")
    number = lambda *by: F.row_number().over(Window.orderBy(*by))
    filled = lacking.withColumn("_nth", number("_no", "_src", "block")).join(free.withColumn("_nth", number("slot")), "_nth")
    return own.unionByName(filled.select("_src", "_no", "block", "slot"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each row, repeats counted.

    The documents of a source, in an order shuffled by a hash of doc_id, form one stream of words, up to three times
    over, cut into blocks of equal size up to the source's quota. Slots and blocks are joined on (source, number), see
    schedule(). Positions are two-level running totals, so a source with a third of all rows is spread over about
    sqrt(rows) buckets. Rows move without their texts.

    Null text has size 0; rows of size 0 have taken 0. Null source is a source of its own. Repeated doc_ids are rows
    of their own. Very long texts are counted in their row and span blocks. Extra columns are ignored. No documents give
    no rows.
    """
    return _mixed(docs, block_words).drop("_k1", "_k2")


def _keys(text: Column) -> list[Column]:
    """What tells the texts of rows that share an id apart."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def _mixed(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """mix(), with two keys of the row's text."""
    spark = docs.sparkSession
    text = whole("text")
    rows = written(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_order"),
            *_keys(text),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = rows.count()
    targets = written(source_targets(sizes))
    keyed = targets.select(
        F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_no"), "source_size", "target", "quota", "low", "high"
    )
    rows = rows.withColumns({"_src": F.coalesce("source", F.lit("")), "_no": F.col("source").isNull()})
    slots = schedule(spark, keyed, block)

    # Blocks: the part of each that a document fills.
    buckets = max(16, int(n**0.5))
    spot = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32))
    placed = running_total(
        rows.filter("size > 0").withColumn("_bucket", spot), ["_src", "_no"], "_bucket", ["_order", "doc_id", "size", "_k1", "_k2"], "size", "_at"
    ).join(keyed.select("_src", "_no", "source_size", "target", "quota"), ["_src", "_no"])
    turns = placed.withColumn("_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)), lambda e: F.col("_at") + F.col("source_size") * e)))
    reach = F.least(F.col("_start") + F.col("size"), "quota")
    pieces = (
        turns.withColumn("_reach", reach).filter("_reach > _start")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_reach") - 1) / block))))
        .withColumn("_words", F.least(F.col("_reach"), (F.col("block") + 1) * block) - F.greatest(F.col("_start"), F.col("block") * block))
    )
    taken = pieces.join(slots, ["_src", "_no", "block"]).groupBy("_src", "_no", "_at").agg(F.sum("_words").alias("taken"))
    own = ["_src", "_no", "doc_id", "source", "size", "_k1", "_k2"]
    drawn = placed.select(*own, "_at").join(taken, ["_src", "_no", "_at"], "left")
    out = drawn.select(*own, F.coalesce("taken", F.lit(0)).alias("taken"))
    out = out.unionByName(rows.filter("size = 0").select(*own, F.lit(0).alias("taken")))
    return out.join(keyed.select("_src", "_no", "source_size", "target"), ["_src", "_no"]).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "_k1", "_k2"
    )


def draw(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each as many times as its words are taken, rounded to whole copies. Of each
    source that has a share but whose documents all round to none, the one most of which is taken stays once (of equals
    that of the least id and key).

    Documents without words take no part in the shares and stay once. Only ids, keys of the texts and numbers of copies
    are joined to the documents; rows that share an id have each their own copies, those that repeat source and text too
    share theirs evenly.
    """
    key = ["doc_id", "source", "_k1", "_k2"]
    each = _mixed(docs).groupBy(*key).agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("_n"))
    share = F.try_divide(F.col("taken"), F.col("size") * F.col("_n"))
    each = written(each.withColumns({"_copies": F.when(F.col("size") == 0, 1).otherwise(F.floor(share + 0.5)).cast("int"), "_share": share}))
    place = F.struct((-F.col("_share")).alias("s"), F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")
    none = each.filter("size > 0").groupBy("source").agg(F.sum("_copies").alias("_all"), F.sum("taken").alias("_words"), F.min(place).alias("_best")).filter("_all = 0 AND _words > 0")
    saved = none.select(F.col("source").alias("_s"), F.col("_best.doc_id").alias("_i"), F.col("_best._k1").alias("_a"), F.col("_best._k2").alias("_b"), F.lit(1).alias("_saved"))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b"))
    told = each.join(saved, same, "left").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), F.coalesce("_saved", "_copies").alias("_copies"))
    told = written(told.filter("_copies > 0"))
    small = told.limit(5 * BROADCAST_ROWS + 1).count() <= 5 * BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").alias("_of"), F.col("source").alias("_from"), *_keys(whole("text")), F.struct(*docs.columns).alias("_row"))  # its columns may have any names
    match = F.col("_of").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2"))
    drawn = rows.join(F.broadcast(told) if small else told, match)
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest
  FROM w
), g AS (
  SELECT *, most * rest <= (total - spent) * weight AS capped FROM f
), h AS (
  SELECT *, total - CAST(sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS BIGINT) AS free,
         CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) AS free_weight
  FROM g
), t AS (
  SELECT source, source_size, total,
         CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(free AS DOUBLE) * weight / greatest(free_weight, 1) END AS target
  FROM h
), e AS (
  SELECT doc_id, source, size,
         CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d
), r AS (
  SELECT e.doc_id, e.size, t.source_size, t.target, e.pos, CAST(floor(t.target + 0.5) AS BIGINT) AS reach
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, reach - pos)) + greatest(0, least(size, reach - pos - source_size))
          + greatest(0, least(size, reach - pos - 2 * source_size)) AS BIGINT) AS taken
FROM r
"""
