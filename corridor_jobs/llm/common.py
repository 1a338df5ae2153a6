"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many rows of two or three short columns are broadcast; larger key sets are joined by shuffle.
BROADCAST_ROWS = 200_000
ROWS_KEY, ROWS_SENT = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a fresh one on a single
    machine, and an error elsewhere."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def written(df: DataFrame, compression: str | None = None, group_rows: int | None = None) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    group_rows: rows of a row group, for rows of megabytes. Parquet first looks at a group's size after 100 rows, and
    Spark reads all rows of a group at once (up to 4,096)."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    groups = {"parquet.block.row.count.limit": str(group_rows)} if group_rows else {}
    df.write.options(**groups).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by written() that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small frames. Spark removes the files once the frame is collected as garbage, where
    spark.cleaner.referenceTracking.cleanCheckpoints is true; else they stay in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(spark: SparkSession) -> None:
    """Has whole texts go to Python workers ROWS_SENT rows at a time, where the session keeps Spark's default of ten
    times as many: a batch is held in memory on both sides."""
    if spark.conf.get(ROWS_KEY) == "10000":
        spark.conf.set(ROWS_KEY, str(ROWS_SENT))


@contextmanager
def rows_sent(spark: SparkSession, rows: int) -> Iterator[None]:
    """Has rows go to Python workers so many at a time, for jobs that run within; then the session is as it was."""
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_KEY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that when every character is one byte; else translate() does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def semi(df: DataFrame, keys: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left semi join. keys must be cheap to count; a set of checked size is broadcast, a larger one shuffled."""
    small = keys.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is not among gone (one column), as they are. A list of checked size is broadcast, so that
    texts stay where they are; a longer one is joined by shuffle. Rows with a null id cannot be named and stay."""
    gone = checkpointed(gone.toDF("_gone").filter("_gone IS NOT NULL").distinct())
    small = gone.limit(5 * BROADCAST_ROWS + 1).count() <= 5 * BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col] == gone["_gone"], "left_anti")


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The documents that are not among gone (id, key of the text), as they are: rows that share an id are told apart by
    their texts, and rows with a null id are found too. A list of checked size is broadcast, a longer one shuffled."""
    gone = checkpointed(gone.toDF("_gone_id", "_gone_key").distinct())
    small = gone.limit(5 * BROADCAST_ROWS + 1).count() <= 5 * BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of weight over the earlier rows of the group, in the order (bucket, *order).

    Two levels, so that a group with most of the rows is no single task: sums of each (group, bucket) are accumulated
    over the buckets, then rows within their bucket. The caller picks about sqrt(rows) buckets.
    """
    each = df.groupBy(*group, bucket).agg(F.sum(weight).alias("_in_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*group, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*group, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_offset")
    )
