"""Exact percentiles of any number of rows, from counts of their values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of values that a key is split into.
BUCKETS = 1024


def weighted_percentiles(counts: DataFrame, keys: Sequence[str], value: str, weight: str, shares: Mapping[str, float], buckets: int = BUCKETS) -> DataFrame:
    """The keys, and for each name in shares that percentile (0 to 1, between two rows linearly) of the value, of which
    there are weight rows. One row a key that has a value at all.

    No key's values come together: they are counted by buckets of equal width between the key's least and largest value;
    running sums over the buckets, at most so many for a key, say in which of them each percentile lies; and only those
    are looked at value by value. counts is read several times and should be a table.
    """
    known = counts.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v"), F.col(weight).alias("_n"))
    own = [f"_k{i}" for i in range(len(keys))] or ["_one"]
    if not keys:
        known = known.withColumn("_one", F.lit(0))
    ends = known.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))

    def with_(rows: DataFrame, more: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        more = more.withColumnsRenamed({c: f"_r{c}" for c in [*own, *extra]})
        same = [rows[c].eqNullSafe(more[f"_r{c}"]) for c in [*own, *extra]]
        return rows.join(more, reduce(lambda a, b: a & b, same)).drop(*(f"_r{c}" for c in [*own, *extra]))

    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")
    placed = with_(known, ends).withColumn("_b", place)
    each = placed.groupBy(*own, "_b").agg(F.sum("_n").alias("_in"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    asked = {n: F.lit(p) * (F.col("_total") - 1) for n, p in shares.items()}
    rows_of = [f(pos).cast("long") for pos in asked.values() for f in (F.floor, F.ceil)]
    held = reduce(lambda a, b: a | b, ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in rows_of))
    few = with_(placed.drop("_total", "_lo", "_hi"), each.filter(held).drop("_in"), ["_b"])
    within = Window.partitionBy(*own, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    summed = few.groupBy(*own, "_b", "_v").agg(F.sum("_n").alias("_n"), F.first("_before").alias("_before"), F.first("_total").alias("_total"))
    few = summed.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    at = lambda row: F.max(F.when((row >= F.col("_from")) & (row < F.col("_from") + F.col("_n")), F.col("_v")))
    found = few.groupBy(*own).agg(F.first("_total").alias("_total"), *(at(f(pos).cast("long")).alias(f"_{end}{n}") for n, pos in asked.items() for end, f in (("lo", F.floor), ("hi", F.ceil))))

    def between(name: str):
        pos = asked[name]
        lo, hi = F.col(f"_lo{name}"), F.col(f"_hi{name}")
        return F.when(F.floor(pos) == F.ceil(pos), lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

    return found.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(between(n).alias(n) for n in shares))
