"""A Merkle manifest of a table: one tree of fan-out FAN per group of rows, and one over the groups' roots.

Leaves are put in order by ranges, so that each partition holds a stretch of them, and numbered within their group. Each
partition runs a mountain-range stack over its stretch: a node waits on the stack of its level until the last of its FAN
siblings comes, whose carry makes the parent. Runs that a partition's edge cuts stay behind as peaks; these, and the short
run at a group's end, are merged level by level across partitions. A short run is hashed as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, checkpointed, table, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Trees are at most so high: FAN ** HIGHEST fits a long.
HIGHEST = 20
_LOW = (1 << 33) - 1  # monotonically_increasing_id() has the partition above these bits, the row below


def encoded(value: Column) -> Column:
    """Bytes, colon, value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**over: Column) -> Column:
    """The digest of a row of FIELDS, some of them given otherwise."""
    return F.sha2(F.concat(*(encoded(over.get(c, F.col(c))) for c in FIELDS)), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def stack(rows: Iterator[tuple[str, int, int, str]], fan: int = FAN) -> Iterator[tuple[str, int, int, int, str, bool]]:
    """(group, depth, idx, digest) in order -> (group, depth, level, idx, digest, peak) of every node above the leaves that
    is complete within the rows, and of the leaves that no such node covers. A peak has no parent among them."""
    waiting: list[list[tuple[int, str]]] = []
    group, depth, following = None, 0, -1

    def left(level: int, peak: bool) -> Iterator[tuple]:
        for i, d in waiting[level]:
            if level or peak:
                yield group, depth, level, i, d, peak
        waiting[level] = []

    def flushed() -> Iterator[tuple]:
        for level in range(len(waiting)):
            yield from left(level, True)

    for g, n, idx, digest in rows:
        if g != group or idx != following:
            yield from flushed()
            group, depth = g, n
        following = idx + 1
        level = 0
        while True:
            if level == len(waiting):
                waiting.append([])
            waiting[level].append((idx, digest))
            if idx % fan < fan - 1:
                break
            if len(waiting[level]) < fan:  # the run begins in an earlier partition
                yield from left(level, True)
                break
            digest = joined([d for _, d in waiting[level]])
            yield from left(level, False)
            level, idx = level + 1, idx // fan
    yield from flushed()


_NODES = "g string, depth int, level int, idx long, digest string, peak boolean"


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["g", "depth", "level", "idx", "digest", "peak"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    for node in stack(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        held.append(node)
        if len(held) >= 10_000:
            yield batch()
            held = []
    yield batch()


@dataclass
class Forest:
    """leaves: g, depth, idx, digest and columns of their own. nodes: g, depth, level (1 and above), idx, digest.
    roots: g, depth, digest. height: the largest depth."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    height: int


def _run(at: str = "idx") -> Column:
    return F.expr(f"{at} div {FAN}")


def forest(leaves: DataFrame, order: list[str]) -> Forest:
    """The trees of leaves (g, a string without nulls; digest; the columns of order; more), one for each g, in the given
    order. Rows alike in all of it may take either's place."""
    placed = written(leaves.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    each = placed.groupBy("g", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("n").over(Window.partitionBy("g"))
    depth = sum((F.when(size > FAN**k, 1).otherwise(0) for k in range(HIGHEST)), F.lit(0)).cast("int")
    stretches = written(each.select("g", "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), depth.alias("depth")))
    height = stretches.agg(F.max("depth")).first()[0] or 0
    numbered = placed.withColumn("_part", part).join(stretches, ["g", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
    made = written(numbered.select("g", "depth", "idx", "digest").sortWithinPartitions("g", "idx").mapInArrow(_stacked, _NODES))
    peaks = made.filter("peak").drop("peak")
    open_ = peaks.filter("level = 0")
    nodes = made.filter("level > 0").drop("peak")
    for level in range(height):
        children = open_.filter(F.col("depth") > level).groupBy("g", "depth", _run().alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))).alias("c"))
        digest = F.sha2(F.array_join("c.digest", ""), 256)
        merged = checkpointed(children.select("g", "depth", F.lit(level + 1).alias("level"), "idx", digest.alias("digest")))
        nodes = nodes.unionByName(merged)
        open_ = peaks.filter(F.col("level") == level + 1).unionByName(merged)
    roots = nodes.filter("level = depth").unionByName(numbered.filter("depth = 0").select("g", "depth", F.lit(0).alias("level"), "idx", "digest"))
    return Forest(numbered, nodes, roots.select("g", "depth", "digest"), height)


def with_paths(trees: Forest, above: DataFrame) -> DataFrame:
    """The leaves with path: from the leaf up, the siblings left and right of each node (their digests joined), then what
    above (g, path, and more that is handed down) says of the root. Levels are joined from the top down, each a FANth of
    the one below, so that only the last join is as large as the leaves."""
    down = [c for c in above.columns if c not in ("g", "path")]
    starts = above.join(trees.roots.select("g", "depth"), "g")
    know = lambda level: starts.filter(F.col("depth") == level).select("g", F.lit(0).cast("long").alias("idx"), "path", *down)
    known = know(trees.height)
    for level in reversed(range(trees.height)):
        rows = trees.nodes.filter((F.col("level") == level) & (F.col("depth") > level)).select("g", "idx", "digest") if level else trees.leaves.filter("depth > 0")
        own = [c for c in rows.columns if c != "g"]
        runs = rows.groupBy("g", _run().alias("_up")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("run"))
        runs = runs.join(known.withColumnRenamed("idx", "_up"), ["g", "_up"])
        digests = F.transform("run", lambda x: x["digest"])
        side = lambda a, n: F.array_join(F.slice(digests, a, n), "")
        step = lambda i: F.struct(side(1, i).alias("left"), side(i + 2, FAN).alias("right"))
        each = F.transform("run", lambda x, i: F.struct(*(x[c].alias(c) for c in own), F.concat(F.array(step(i)), F.col("path")).alias("path")))
        known = runs.select("g", *down, F.inline(each))
        known = known.select("g", *(own if level == 0 else ["idx"]), "path", *down)
        if level:
            known = known.unionByName(know(level))
    lone = trees.leaves.filter("depth = 0").join(starts.drop("depth"), "g")
    return lone if not trees.height else known.unionByName(lone.select(known.columns))


_NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def manifest(docs: DataFrame, start: Column | None = None) -> DataFrame:
    """doc_id, leaf, start, subroot, root, path: every row of documents in the tree of its lang.

    A leaf is the digest of the row (FIELDS, each with its length; null as a hyphen). Leaves of a lang go by doc_id (null
    first, then equal ones by their digest), langs by their bytes, null first. start is a digest to begin folding with
    (the leaf, if none is given). Long texts are hashed in their row. Rows that repeat in every field are leaves of their
    own. Extra columns are ignored; an empty table gives no rows.
    """
    leaf = leaf_of()
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), "doc_id", leaf.alias("digest"), (leaf if start is None else start).alias("start"))
    trees = forest(rows, ["doc_id", "digest"])
    tops = forest(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest"), ["lang"])
    none = tops.roots.select("g", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    above = with_paths(tops, none).select(F.col("lang").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    return with_paths(trees, written(above)).select("doc_id", F.col("digest").alias("leaf"), "start", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def verified(docs: DataFrame, start: Column | None = None) -> DataFrame:
    """manifest(), with proof_sha256, folded_root (of start) and verified in place of start and path."""
    rows = manifest(docs, start)
    rows = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": folded(F.col("start"), F.col("path"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).drop("start", "path")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verified(docs, F.when(drawn, leaf_of(text=ascii_lower(F.col("text")))).otherwise(leaf_of()))



def _sql_leaf(text: str = "text") -> str:
    each = [f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return "sha256(" + " || ".join(each) + ")"


#: The CRC-32 of a decimal number in bits, eight steps a byte; the constant is its reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
_STEP = f"""SELECT t, g, l + 1 AS l, i // {FAN} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM
  (SELECT *, count(*) OVER (PARTITION BY t, g) AS n FROM {{}}) z WHERE n > 1 GROUP BY t, g, l, i // {FAN}"""
_SIDES = f"""SELECT {{key}}, l, array_to_string(ds[:k], '') AS lft, array_to_string(ds[k + 2:], '') AS rgt FROM
  (SELECT {{key}}, r.l, r.ds, (x.i // CAST({FAN} ** r.l AS BIGINT)) % {FAN} AS k FROM {{leaves}} x JOIN runs r ON r.t = {{t}} AND r.g = x.g AND r.n > 1 AND r.p = x.i // CAST({FAN} ** (r.l + 1) AS BIGINT)) z"""
SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf()} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_sql_leaf()} END AS begun
  FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
low AS (SELECT 0 AS t, g, 0 AS l, i, leaf AS d FROM placed UNION ALL ({_STEP.format('low')})),
tops AS (SELECT g, arg_max(d, l) AS subroot FROM low GROUP BY g),
ranked AS (SELECT g AS lang, '' AS g, subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM tops),
high AS (SELECT 1 AS t, '' AS g, 0 AS l, i, subroot AS d FROM ranked UNION ALL ({_STEP.format('high')})),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
sized AS (SELECT *, count(*) OVER (PARTITION BY t, g, l) AS n FROM nodes),
runs AS (SELECT t, g, l, i // {FAN} AS p, max(n) AS n, list(d ORDER BY i) AS ds FROM sized GROUP BY t, g, l, i // {FAN}),
sides AS ({_SIDES.format(key='x.g, x.i', leaves='placed', t=0).replace('SELECT x.g, x.i, l,', 'SELECT g, i, l,', 1)}),
upper AS ({_SIDES.format(key='x.lang', leaves='ranked', t=1).replace('SELECT x.lang, l,', 'SELECT lang, l,', 1)}),
steps AS (SELECT g, i, l, lft, rgt FROM sides UNION ALL SELECT p.g, p.i, 100 + l, lft, rgt FROM placed p JOIN upper u ON p.g = u.lang),
paths AS (SELECT g, i, list(lft || '|' || rgt ORDER BY l) AS path, string_agg(lft || rgt, '' ORDER BY l) AS every FROM steps GROUP BY g, i),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT arg_max(d, l) FROM high) AS root, sha256(coalesce(every, '')) AS proof_sha256,
         list_reduce(list_prepend(begun, coalesce(path, [])), lambda d, s: sha256(string_split(s, '|')[1] || d || string_split(s, '|')[2])) AS folded_root
  FROM placed p JOIN tops t ON p.g = t.g LEFT JOIN paths q ON p.g = q.g AND p.i = q.i
)
SELECT *, folded_root = root AS verified FROM done
"""
