"""Chains of resumed runs: where each came from, what of each still counts, and where a chain leaves its reference.

A run names the run whose checkpoint it took up, or none. Chains are followed by doubling: in each round every run looks
up the run that it has reached so far, so a chain of n runs takes log2(n) joins, not n, and each round is a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..guards import Rules, require
from ..sources import scratch

CHECKPOINT = r"^(.*?)/*checkpoint-(\d+)/*$"


def resumed_from(manifests: DataFrame, checkpoint: str = "resume") -> DataFrame:
    """Adds `parent` and `parent_step`, read from the path of the checkpoint that a run was resumed from; null for none."""
    path = F.col(checkpoint)
    part = lambda i: F.nullif(F.regexp_extract(path, CHECKPOINT, i), F.lit(""))
    return manifests.withColumns({"parent": F.regexp_replace(part(1), "/+$", ""), "parent_step": part(2).cast("long")})


def lineage(runs: DataFrame) -> DataFrame:
    """(run, origin, depth, path array<run>, status) of `runs`: (run, parent), one row a run.

    `path` leads from the origin to the run. status: "whole"; "parent missing" where the first run of the path names a run
    that isn't there, and the path starts with the first that is; "cycle" where following parents never ends, with null
    origin, depth and path. A run that occurs twice with different parents is refused; repeated rows count once.
    An empty table has no lineages; a null run is left out, since nothing can name it.
    """
    given = scratch.stored(runs.filter("run IS NOT NULL").select("run", "parent").distinct(), "runs")
    clash = given.groupBy("run").count().filter("count > 1").first()
    require(clash is None, f"a run has several parents: {clash}")
    known = given.select(F.col("run").alias("parent"), F.lit(True).alias("_there"))
    start = given.join(known, "parent", "left").select("run", F.when(F.col("_there"), F.col("parent")).alias("next"), F.array("run").alias("path"), (F.col("parent").isNotNull() & F.col("_there").isNull()).alias("lost"), F.lit(False).alias("stuck"))
    told = scratch.stored(start, "lineage")
    longest = max(1, given.count()).bit_length()
    for _ in range(longest):
        if told.filter("next IS NOT NULL AND NOT stuck").isEmpty():
            break
        far = told.select(F.col("run").alias("next"), F.col("next").alias("_next"), F.col("path").alias("_path"), F.col("lost").alias("_lost"))
        grown = told.join(far, "next", "left")
        # A path that meets itself belongs to a cycle and would only double, so it is left as it is.
        meets = F.coalesce(F.arrays_overlap("path", "_path"), F.lit(False))
        still = F.col("next").isNull() | meets
        told = scratch.stored(
            grown.select(
                "run",
                F.when(still, F.col("next")).otherwise(F.col("_next")).alias("next"),
                F.when(still, F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
                F.when(still, F.col("lost")).otherwise(F.col("_lost")).alias("lost"),
                meets.alias("stuck"),
            ),
            "lineage",
        )
    ends = F.col("next").isNull()
    return told.select(
        "run",
        F.when(ends, F.get("path", F.lit(0))).alias("origin"),
        F.when(ends, F.size("path") - 1).cast("long").alias("depth"),
        F.when(ends, F.col("path")).alias("path"),
        F.when(~ends, "cycle").when(F.col("lost"), "parent missing").otherwise("whole").alias("status"),
    )


def stretches(lineages: DataFrame, starts: DataFrame) -> DataFrame:
    """(run, source, first_step, end_step): which run's rows tell which steps of a resumed run's whole history.

    `starts`: (run, start_step). A run counts up to where the next of the path took over; the last has no end (null).
    """
    rows = lineages.filter("path IS NOT NULL").select("run", F.posexplode("path").alias("at", "source"))
    begun = rows.join(starts.select(F.col("run").alias("source"), "start_step"), "source")
    # Pairs of neighbours by a shifted key rather than a sort of each path.
    later = begun.select("run", (F.col("at") - 1).alias("at"), F.col("start_step").alias("end_step"))
    return begun.join(later, ["run", "at"], "left").select("run", "source", F.col("start_step").alias("first_step"), "end_step")


def chain_rules() -> Rules:
    """Bad runs (run, parent, parent_step, start_step, parent_start, parent_last): resumed where the checkpoint wasn't, or before the parent began."""
    resumed = F.col("parent").isNotNull()
    return {
        "starts elsewhere than its checkpoint": resumed & ~F.col("start_step").eqNullSafe(F.col("parent_step")),
        "parent missing": resumed & F.col("parent_start").isNull(),
        "checkpoint before the parent": resumed & F.coalesce(F.col("parent_step") <= F.col("parent_start"), F.lit(False)),
        "checkpoint after the parent's last step": resumed & F.coalesce(F.col("parent_step") > F.col("parent_last") + 1, F.lit(False)),
    }


def stitched(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of whole histories: a run's steps, each told by the youngest run of its path that has come that far.

    Rows meet their stretch by the run that wrote them, so a run that many others go back to is read for each of them.
    """
    own = rows.withColumnRenamed("run", "source").join(pieces, "source")
    inside = (F.col("step") >= F.col("first_step")) & (F.col("end_step").isNull() | (F.col("step") < F.col("end_step")))
    return own.filter(inside).drop("first_step", "end_step")


def first_differences(histories: DataFrame, references: DataFrame, columns: Sequence[str], key: str = "reference") -> DataFrame:
    """(run, steps, missing, differing, first_step, paths, equal) of histories against their references.

    `histories`: (run, reference, rank, step, columns), `references`: (reference, rank, step, columns). Null equals null and
    NaN equals NaN. `missing` rows are of the history's span in one of both only; `paths` are the columns that differ
    at the first step which does, "row" for a row that one side lacks.
    """
    spans = histories.groupBy("run", key).agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    a = histories.select("run", key, "rank", "step", F.struct(*columns).alias("a"))
    b = references.select(key, "rank", "step", F.struct(*columns).alias("b")).join(spans, key).filter(F.col("step").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    both = a.join(b, ["run", key, "rank", "step"], "full")
    lacks = F.col("a").isNull() | F.col("b").isNull()
    differ = F.when(lacks, F.array(F.lit("row"))).otherwise(F.array_compact(F.array(*[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in columns])))
    steps = both.withColumns({"_paths": differ, "_lacks": lacks}).groupBy("run", "step").agg(F.count_if("_lacks").alias("missing"), F.count_if((F.size("_paths") > 0) & ~F.col("_lacks")).alias("differing"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_paths")))).alias("paths"))
    bad = F.size("paths") > 0
    found = steps.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.sum("missing").alias("missing"), F.sum("differing").alias("differing"), F.min(F.when(bad, F.struct("step", "paths"))).alias("first"))
    return found.select("run", "steps", "missing", "differing", F.col("first.step").alias("first_step"), F.col("first.paths").alias("paths"), F.col("first").isNull().alias("equal"))
