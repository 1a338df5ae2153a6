"""Frames kept in the folder that driver and executors share, and rows in order where a key may be hot."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the folder of spark.checkpoint.dir, from where a lost executor's part is read again. Where
    none is set, a fresh folder on a single machine, and an error elsewhere."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def all_known(keys: Sequence[str]) -> Column:
    """Whether none of the keys is null."""
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))


#: Up to so many rows of a few short columns are broadcast, after they are counted; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The frame, which should be cheap as it is counted: to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def semi(df: DataFrame, keys: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """The rows of df whose columns (the keys of on) are among the key columns (its values). keys is counted, so should be
    cheap: a small set is broadcast, and then prunes df's partitions while it is scanned; a larger one is shuffled."""
    few = small(keys.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(on.values()))).distinct())
    return df.join(few, reduce(lambda a, b: a & b, (df[c] == few[f"_k{i}"] for i, c in enumerate(on))), "left_semi")


#: Parts that rows with a null key are dealt to, as they have no row before them and need not meet.
NULL_PARTS = 1024


def with_previous(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column], order: Sequence[str], column: str, out: str) -> DataFrame:
    """Adds out, the column's value in the row before of the same keys, in the order (*bucket, *order); null where a key is
    null.

    Two levels, so that a key with most of the rows is no single task. Rows are put in order within a bucket; the last row
    of each bucket, found with map-side combine, is carried to the next bucket of the key. Nulls come last in buckets and
    order. Rows are shuffled once, by key and bucket; a key has one row a bucket at the second level.
    """
    parts = [f"_b{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(parts, bucket, strict=True)) | {"_nulls": F.when(~all_known(keys), F.pmod(F.hash(*order), F.lit(NULL_PARTS)))})
    within = Window.partitionBy(*keys, *parts, "_nulls").orderBy(*(F.asc_nulls_last(c) for c in order))
    rows = rows.withColumns({"_before": F.lag(column).over(within), "_place": F.row_number().over(within)})
    last = F.max_by(F.struct(F.col(column).alias("v")), F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c)))))
    ends = df.withColumns(dict(zip(parts, bucket, strict=True))).filter(all_known(keys)).groupBy(*keys, *parts).agg(last.alias("_last"))
    following = Window.partitionBy(*keys).orderBy(*(F.asc_nulls_last(p) for p in parts))
    carried = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(p).alias(f"_c{p}") for p in parts), F.lag("_last").over(following).alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(p).eqNullSafe(F.col(f"_c{p}")) for p in parts]
    joined = rows.join(carried, reduce(lambda a, b: a & b, same), "left")
    value = F.when(all_known(keys), F.when(F.col("_place") > 1, F.col("_before")).otherwise(F.col("_carried.v")))
    return joined.withColumn(out, value).select(*df.columns, out)
