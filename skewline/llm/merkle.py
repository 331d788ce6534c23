"""Merkle manifest of a dataset: a digest of every row, of every group of rows, and of the whole, with each row's proof.

A leaf is the SHA-256 of a row's fields; every `arity` consecutive nodes of a level, the last run fewer, even one, become the
SHA-256 of their digests, until one node is left. Leaves are numbered within their group, and cut into aligned blocks of
`arity` ** `height`; a task walks a block in postorder, returns the digest of each subtree and, while it unwinds, appends the
siblings of a node to the path of every leaf that the node contains. Roots of blocks are the leaves of the next, equal
traversal, until a group has one block; roots of groups, in order of the group, are the leaves of one more tree. Paths are put
together from the top, where rows are few, so only the last join has a row for each leaf, and its keys are blocks.

Numbering sorts by ranges that split a hot group and even rows that are all alike, and counts ranges before rows. No text
takes part: it is hashed where it is read.

Defined results: a null field is `-`, so null, empty and "-" differ; a null group comes first, a null order key too; rows alike in
group and order key stand in order of their leaves; repeated rows are leaves of their own; a table of one row has its leaf
as root and an empty path; an empty table gives an empty table; columns not named are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 2
HEIGHT = 10
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(c: Column) -> Column:
    """A field as it is hashed: `-` for null, else its number of UTF-8 bytes, `:`, its text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*[field(c) for c in fields])


def traverse(digests: Sequence[str], height: int, arity: int = ARITY) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of leaves, `height` levels up, and each leaf's siblings on the left and right of it, from the leaf upwards."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(lo: int, level: int) -> str:
        if level == 0:
            return digests[lo]
        width = arity ** (level - 1)
        starts = range(lo, min(lo + width * arity, len(digests)), width)
        below = [visit(at, level - 1) for at in starts]
        for i, at in enumerate(starts):
            siblings = ("".join(below[:i]), "".join(below[i + 1 :]))
            for path in paths[at : at + width]:
                path.append(siblings)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return visit(0, height), paths


def levels(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves until one node is left."""
    height, width = 0, 1
    while width < n:
        height, width = height + 1, width * arity
    return height


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds _at, a row's place within its group from 0, and _n, the group's rows. `group` has no nulls; `rows` is a stored table."""
    by = [group, *order, "_copy"]
    ranged = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    stored = written(ranged.drop("_copy").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    spans = stored.groupBy(group, part).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_base"), F.sum("_rows").over(Window.partitionBy(group)).alias("_n"))
    placed = stored.withColumn("_part", part).join(spans, [group, "_part"])
    return placed.withColumn("_at", F.col("_base") + F.col("_place") - F.col("_first")).drop("_part", "_place", "_first", "_base")


def walked(nodes: DataFrame, group: str, arity: int, height: int) -> DataFrame:
    """Each node's path within its block, and the block's number and root. nodes: group, _at, _n, _digest and what is carried along."""
    block = arity**height
    schema = nodes.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at, n = table["_at"][0].as_py(), table["_n"][0].as_py()
        root, paths = traverse(table["_digest"].to_pylist(), height if n > block else levels(n, arity), arity)
        flat = [step for path in paths for step in path]
        offsets = [0]
        for path in paths:
            offsets.append(offsets[-1] + len(path))
        steps = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], names=["left", "right"])
        more = {"_path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps).cast(_PATH), "_block": pa.array([at // block] * len(table), pa.int64()), "_root": pa.array([root] * len(table))}
        table = table.drop_columns("_of")
        for name, column in more.items():
            table = table.append_column(name, column)
        return table

    dealt = nodes.withColumn("_of", F.floor(F.col("_at") / block))
    return dealt.groupBy(group, "_of").applyInArrow(walk, f"{schema}, _path {PATH}, _block bigint, _root string")


def forest(rows: DataFrame, group: str, order: Sequence[str], arity: int = ARITY, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The walked levels of all groups' trees, leaves first, and (group, _root) of each group."""
    block = arity**height
    stages = [written(walked(numbered(rows, group, order), group, arity, height))]
    most = stages[0].agg(F.max("_n")).first()[0] or 0
    while most > block:
        below, most = stages[-1], -(-most // block)
        roots = below.filter(F.col("_at") % block == 0)
        nodes = roots.select(group, F.col("_block").alias("_at"), F.ceil(F.col("_n") / block).alias("_n"), F.col("_root").alias("_digest"))
        stages.append(written(walked(nodes, group, arity, height)))
    return stages, stages[-1].filter("_at = 0").select(group, "_root")


def paths_up(stages: list[DataFrame], group: str, top: DataFrame) -> DataFrame:
    """Rows of the first stage with their whole _path; `top`: (group, _path and what else holds for a group), joined to the last stage."""
    extra = [c for c in top.columns if c not in (group, "_path")]
    above = top.withColumn("_block", F.lit(0).cast("long"))
    for stage in reversed(stages):
        joined = stage.join(above.withColumnRenamed("_path", "_above"), [group, "_block"])
        above = joined.withColumn("_path", F.concat("_path", "_above"))
        out = above.drop("_above", "_block", "_root", "_n")
        above = above.select(group, F.col("_at").alias("_block"), "_path", *extra)
    return out


def merkle(rows: DataFrame, leaf_column: str, group_column: str, order_column: str, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """`rows` without the group, with subroot and root (string) and path: from the leaf to the root, the digests on the left and right.

    All columns of `rows` are carried along, so it should hold digests and keys, not texts.
    """
    kept = [c for c in rows.columns if c != group_column]
    # Nulls first, then by bytes; a string that is never null, so it can be a key of joins.
    key = F.when(F.col(group_column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_column).cast("string")))
    leaves = written(rows.select(key.alias("_group"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)], F.col(order_column).alias("_order"), F.col(leaf_column).alias("_digest")))
    stages, subroots = forest(leaves, "_group", ["_order", "_digest"], arity, height)
    trees = written(subroots.select(F.lit("").alias("_all"), "_group", F.col("_root").alias("_digest")))
    above, roots = forest(trees, "_all", ["_group"], arity, height)
    top = roots.select("_all", F.col("_root").alias("root")).withColumn("_path", F.expr("array()").cast(PATH))
    groups = paths_up(above, "_all", top).select("_group", "_path", F.col("_digest").alias("subroot"), "root")
    done = paths_up(stages, "_group", groups)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "subroot", "root", F.col("_path").alias("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, step: digest(step["left"], d, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
