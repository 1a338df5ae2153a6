"""Writers of signal ranges and of the rows behind maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import line_text
from ..operators.validation import RANGE_COLUMNS

SIGNAL_RANGES = ["TspAssetID", "osmid", "Name", "x", "y", *RANGE_COLUMNS]


def write_signal_ranges(df: DataFrame, path: str) -> None:
    df.select(*SIGNAL_RANGES).write.mode("overwrite").csv(path, header=True)


def write_geometry_table(df: DataFrame, path: str, lines: Sequence[str], partition_by: Sequence[str] = ("shape_id", "feed_key")) -> None:
    """Rows with their lines as WKT text, partitioned by shape and feed. Rows are dealt out by the partition columns
    first, so that each folder gets few files."""
    text = df.withColumns({c: line_text(F.col(c)) for c in lines})
    text.repartition(*partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
