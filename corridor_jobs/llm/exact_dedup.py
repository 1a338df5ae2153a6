"""Exact dedup by progressive refinement: byte length, then prefix hash, then full hash (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, UPPER, ascii_lower, checkpointed, semi, table, whole, without_rows, written

PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Lengths that occur once are final at once; of the rest,
    prefixes that occur once; only what then survives has its full content hashed (all rows if digest_all, for callers
    that want the digest anyway; else text_sha256 is null where content was not read). Each refinement is a count with
    map-side combine, so a group holding a third of all rows reaches its reducer as one row per task.

    Null text counts as empty. Null ids rank below all others (keep_id is null if a group has no other). Rows that
    repeat both id and text cannot be told apart and share one verdict. Very long texts are hashed in their row. Extra columns are ignored; an empty table
    gives no rows.
    """
    return _verdicts(docs, id_col, text_col, digest_all).drop("_key")


def _key(text: Column) -> Column:
    return F.xxhash64(ascii_lower(text))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """exact_groups(), with _key of the text (null where its content was not read)."""
    text = whole(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("_prefix"),
    )
    lengths = checkpointed(keyed.groupBy("_len").count().filter("count > 1").select("_len"))
    prefixes = checkpointed(
        semi(keyed.select("_len", "_prefix"), lengths, ["_len"])
        .groupBy("_len", "_prefix")
        .count()
        .filter("count > 1")
        .select("_len", "_prefix")
    )
    digest = F.sha2(ascii_lower(F.col("_text")), 256).alias("text_sha256")
    if digest_all:
        rows = written(keyed.select("doc_id", "_len", "_prefix", _key(F.col("_text")).alias("_key"), digest))
        groups = _groups(semi(rows, prefixes, ["_len", "_prefix"]))
    else:
        small = prefixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        marked = F.broadcast(prefixes) if small else prefixes
        hashed = written(keyed.join(marked, ["_len", "_prefix"], "left_semi").select("doc_id", _key(F.col("_text")).alias("_key"), digest))
        groups = _groups(hashed)
        rest = keyed.select("doc_id", "_len", "_prefix").join(marked, ["_len", "_prefix"], "left_anti")
        rows = hashed.unionByName(rest.select("doc_id", F.lit(None).cast("long").alias("_key"), F.lit(None).cast("string").alias("text_sha256")))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "_key",
    )


def _groups(hashed: DataFrame) -> DataFrame:
    return (
        hashed.groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Rows that share an id are judged each by its own text; of equal
    texts none of which has an id all stay, as do rows that repeat the id and text of the one that stays."""
    gone = _verdicts(docs, "doc_id", "text", False).filter("NOT kept").select("doc_id", "_key")
    return without_rows(docs, gone, _key(whole(docs["text"])))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
