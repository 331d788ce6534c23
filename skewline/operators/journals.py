"""Durable journals: sequences, committed prefixes, frontiers and the status of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ROW_BYTES = 65_536


def sequence_breaks(rows: DataFrame, keys: list[str], start: str = "start_step") -> DataFrame:
    """Rows whose step isn't the start plus their place: gaps, repeats and wrong order, in order of `position`."""
    order = Window.partitionBy(*keys).orderBy("position")
    return rows.withColumn("expected", F.col(start) + F.row_number().over(order) - 1).filter("step != expected")


def committed(files: DataFrame) -> DataFrame:
    """Rows of each journal's committed prefix, and whether the prefix is what its marker says.

    `files` has content (binary) and the marker's fields; what follows the prefix is not looked at.
    """
    prefix = F.substring(F.col("content"), F.lit(1), F.col("bytes").cast("int"))
    checked = files.withColumn("prefix", prefix).withColumn("intact", (F.octet_length("prefix") == F.col("bytes")) & (F.sha2("prefix", 256) == F.col("sha256")))
    ends = (F.col("bytes") == 0) | (F.substring(F.col("prefix"), F.col("bytes").cast("int"), F.lit(1)) == F.lit(b"\n"))
    lines = F.filter(F.split(F.decode("prefix", "UTF-8"), "\n", -1), lambda x: x != "")
    checked = checked.withColumn("lines", F.when(F.col("intact") & ends, lines).otherwise(F.expr("array()").cast("array<string>")))
    return checked.withColumn("intact", F.col("intact") & ends & (F.size("lines") == F.col("rows")) & ~F.exists("lines", lambda x: F.octet_length(x) + 1 > MAX_ROW_BYTES))


def committed_rows(files: DataFrame, schema) -> DataFrame:
    """Parsed rows of intact journals, with their place."""
    exploded = committed(files).filter("intact").select("run", "rank", F.col("start_step"), F.posexplode("lines").alias("position", "line"))
    return exploded.select("run", F.col("rank").alias("journal_rank"), "start_step", "position", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("run", "journal_rank", "start_step", "position", "r.*")


def frontiers(markers: DataFrame, worlds: DataFrame) -> DataFrame:
    """(run, world_size, ranks, durable_through_step, status): durable where all ranks are; invalid before complete before partial.

    `markers`: (run, rank, last_step, intact, complete).
    """
    by_run = markers.groupBy("run").agg(F.count("last_step").alias("ranks"), F.min("last_step").alias("least"), F.bool_or(~F.col("intact")).alias("bad"), F.bool_and("complete").alias("done"))
    rows = worlds.join(by_run, "run", "left").withColumn("ranks", F.coalesce("ranks", F.lit(0)))
    whole = F.col("ranks") == F.col("world_size")
    status = F.when(F.coalesce("bad", F.lit(False)), "invalid").when(whole & F.coalesce("done", F.lit(False)), "complete").otherwise("partial")
    return rows.select("run", "world_size", "ranks", F.when(whole, F.col("least")).alias("durable_through_step"), status.alias("status"))


def run_status(status: DataFrame, worlds: DataFrame) -> DataFrame:
    """(run, world_size, ranks, durable_through_step, status) of runs, from the status of their journals.

    A journal that is invalid makes its run so, and so does one of a completed run that isn't complete; only a run with a
    manifest is complete.
    """
    bad = (F.col("status") == "invalid") | (F.col("completed") & (F.col("status") != "complete"))
    by_run = status.groupBy("run").agg(F.count("last_step").alias("ranks"), F.min("last_step").alias("least"), F.bool_or(bad).alias("bad"), F.bool_and("completed").alias("done"))
    rows = worlds.join(by_run, "run", "left").withColumn("ranks", F.coalesce("ranks", F.lit(0)))
    told = F.when(F.coalesce("bad", F.lit(False)), "invalid").when(F.coalesce("done", F.lit(False)), "complete").otherwise("partial")
    return rows.select("run", "world_size", "ranks", F.when(F.col("ranks") == F.col("world_size"), F.col("least")).alias("durable_through_step"), told.alias("status"))


def marker_mismatches(markers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Ranks whose own marker and the manifest's disagree, either missing included."""
    fields = [c for c in markers.columns if c not in ("run", "rank")]
    a = markers.select("run", "rank", F.struct(*fields).alias("own"))
    b = manifests.select("run", "rank", F.struct(*fields).alias("recorded"))
    return a.join(b, ["run", "rank"], "full").filter(~F.col("own").eqNullSafe(F.col("recorded")))


def provenance(status: DataFrame) -> DataFrame:
    """(run, flushes, flushed_within) from the status of journals: whether any rank wrote before its run's end, as their markers count.

    A rank that wrote more than once did, and so did one that wrote and hasn't ended. Null where no journal has rows.
    """
    within = (F.col("flushes") > 1) | ((F.col("flushes") == 1) & (F.col("status") != "complete"))
    return status.groupBy("run").agg(F.max("flushes").alias("flushes"), F.max(within).alias("flushed_within"))
