"""Key and join checks. check_*() return the offending keys, and require() raises if there are any; asserted*() are part of
the plan that they guard: the rows go through, and the job fails at the first that is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def check_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys repeated on either side."""
    a = check_unique(left, keys).withColumn("side", F.lit("left"))
    return a.unionByName(check_unique(right, keys).withColumn("side", F.lit("right")))


def check_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys repeated on the right."""
    return check_unique(right, keys)


def check_one_to_many(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys repeated on the left."""
    return check_unique(left, keys)


def check_count(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Wanted keys that df does not have exactly once."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = wanted.select(*keys).distinct().join(have, keys, "left")
    return counted.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).filter("n_rows <> 1")


def require(violations: DataFrame, what: str) -> None:
    """Raises ValueError naming a few offending keys."""
    if found := violations.take(5):
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def asserted(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """The rows; fails at one for which ok is not true."""
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def asserted_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; fails where keys repeat. Rows are put together by the keys, as a join or aggregation by them does anyway,
    and pass one by one."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return asserted(df.withColumn("_place", place), F.col("_place") == 1, f"repeated {', '.join(keys)}").drop("_place")


def asserted_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """The join; fails where keys repeat on the right."""
    return left.join(asserted_unique(right, keys), keys, how)


def asserted_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """The join; fails where keys repeat on either side."""
    return asserted_unique(left, keys).join(asserted_unique(right, keys), keys, how)
