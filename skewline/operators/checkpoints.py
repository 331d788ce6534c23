"""Checkpoint inventories: sealing, verification, compatibility and selection, as rules over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_json

#: Settings that may differ between a checkpoint and the run that resumes it (fixed values).
MUTABLE = ("steps", "warmup", "profile", "nvtx", "profile_steps", "checkpoint_every", "diagnostic_sync", "metrics_flush_every")
SHARD = r"\A__\d+_\d+\.distcp\z"
METADATA = ".metadata"


def seal(rows: DataFrame) -> DataFrame:
    """(checkpoint, files, files_sha256): a checkpoint's inventory with one hash over it."""
    entries = F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256")))
    return rows.groupBy("checkpoint").agg(entries.alias("files")).withColumn("files_sha256", F.sha2(F.to_json("files").cast("binary"), 256))


def storage_mismatches(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Files that the marker and the storage don't have alike: (checkpoint, path, reason)."""
    a = declared.select("checkpoint", F.explode("files").alias("f")).select("checkpoint", "f.path", F.struct("f.bytes", "f.sha256").alias("declared"))
    b = found.select("checkpoint", "path", F.struct("bytes", "sha256").alias("found"))
    both = a.join(b, ["checkpoint", "path"], "full").filter(~F.col("declared").eqNullSafe(F.col("found")))
    reason = F.when(F.col("declared").isNull(), "not in the inventory").when(F.col("found").isNull(), "missing").when(F.col("declared.bytes") != F.col("found.bytes"), "size").otherwise("content")
    return both.select("checkpoint", "path", reason.alias("reason"))


def marker_rules() -> dict[str, Column]:
    names = F.transform("files", lambda f: f["path"])
    return {
        "schema": ~F.col("schema_version").isin(1, 2),
        "step": F.coalesce(F.col("step") < 1, F.lit(True)),
        "world size": F.coalesce(F.col("world_size") < 1, F.lit(True)),
        "configuration": F.col("config").isNull(),
        "not sealed": F.coalesce(F.col("schema_version") == 1, F.lit(True)),
        "inventory": F.coalesce((F.size("files") < 2) | (F.size(F.array_distinct(names)) != F.size(names)) | ~F.array_contains(names, METADATA) | ~F.exists(names, lambda n: n.rlike(SHARD)), F.lit(True)),
        "directory name": F.col("checkpoint") != F.concat(F.lit("checkpoint-"), F.col("step").cast("string")),
    }


def compatibility_rules(world: int, steps: int, config: dict[str, str], fleet_sha256: str | None = None, dataset_sha256: str | None = None, torch_version: str | None = None) -> dict[str, Column]:
    wanted = F.create_map(*[F.lit(x) for k, v in config.items() for x in (k, v)]) if config else F.create_map().cast("map<string,string>")
    changed = F.map_filter("config", lambda k, v: ~k.isin(*MUTABLE) & ~F.try_element_at(wanted, k).eqNullSafe(v))
    rules = {
        "world size differs": F.col("world_size") != world,
        "fleet": ~F.col("fleet_sha256").eqNullSafe(F.lit(fleet_sha256)),
        "dataset": ~F.col("dataset_sha256").eqNullSafe(F.lit(dataset_sha256)),
        "configuration changed": F.size(changed) > 0,
        "no steps remain": F.col("step") >= steps,
    }
    if torch_version:
        rules["torch version"] = F.coalesce(F.col("torch_version") != torch_version, F.lit(False))
    return rules


def inspect(markers: DataFrame, mismatches: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(checkpoint, step, sha256, status, reasons) of every candidate."""
    from ..guards import broken

    bad = mismatches.groupBy("checkpoint").agg(F.sort_array(F.collect_set("reason")).alias("storage"))
    rows = markers.join(bad, "checkpoint", "left").withColumn("reasons", F.concat(broken({**marker_rules(), **rules}), F.coalesce(F.transform("storage", lambda r: F.concat(F.lit("storage "), r)), F.expr("array()").cast("array<string>"))))
    return rows.select("checkpoint", "step", "sha256", F.when(F.size("reasons") == 0, "eligible").otherwise("rejected").alias("status"), "reasons")


def select(inspected: DataFrame) -> DataFrame:
    """The eligible checkpoint of the largest (step, name, hash): one aggregation, no sort."""
    best = F.max(F.struct("step", "checkpoint", "sha256")).alias("b")
    return inspected.filter("status = 'eligible'").agg(best).filter("b IS NOT NULL").select("b.*")


def content_identity(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def compare_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, elements, missing, max_error, equal) of two states in long form, (path, index, value); null equals null, NaN equals NaN."""
    left = a.select("path", "index", F.col("value").alias("x"), F.lit(1).alias("in_a"))
    right = b.select("path", "index", F.col("value").alias("y"), F.lit(1).alias("in_b"))
    both = left.join(right, ["path", "index"], "full")
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("missing"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_error"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))
