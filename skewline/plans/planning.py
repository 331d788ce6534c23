"""Batch plans over tables: dealing, costs, capacities, bounds and certificates as plans; searches as grouped functions."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import padded_cost, permits, rank_cost
from ..guards import require
from ..operators import fleet
from ..schemas import RANK_MODEL
from ..sources import scratch
from . import search


def permutation(n: int, seed: int) -> list[int]:
    """Sample ids shuffled by Python's generator, for plans that other tools made with the same seed."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def seeded_order(spark, n: int, seed: int) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"place": range(n), "id": permutation(n, seed)}), "place long, id long")


def hash_key(seed: int, id_column: str = "id") -> Column:
    """Orders samples at random, alike in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary"))


def deal(samples: DataFrame, world: int, batch: int, seed: int, id_column: str = "id") -> DataFrame:
    """Adds step, rank and pos: samples in hash order, cut into global batches; an incomplete last batch is dropped.

    The place in the order is found in two levels: the first byte of the hash cuts the order into 256 ranges, whose sizes
    are summed up, and only a range is sorted at a time.
    """
    rows = samples.withColumn("_key", hash_key(seed, id_column)).withColumn("_range", F.substring("_key", 1, 2))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range")
    base = sizes.select("_range", (F.sum("_n").over(before) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_range").orderBy("_key", id_column)
    place = F.col("_base") + F.row_number().over(within) - 1
    size = world * batch
    rows = rows.join(F.broadcast(base), "_range").withColumn("_place", place).filter(F.col("_place") < F.col("_all") - F.col("_all") % size)
    at = F.col("_place") % size
    return rows.withColumns({"step": F.floor(F.col("_place") / size), "rank": F.floor(at / batch), "pos": at % batch}).drop("_key", "_range", "_n", "_base", "_all", "_place")


def group_shapes(plan: DataFrame, length: str = "length") -> DataFrame:
    """(step, rank, count, width, tokens, padded_cost) of each rank's share."""
    shapes = plan.groupBy("step", "rank").agg(F.count(F.lit(1)).alias("count"), F.max(F.col(length) - 1).alias("width"), F.sum(F.col(length) - 1).alias("tokens"))
    return shapes.withColumn("padded_cost", padded_cost("count", "width"))


def with_models(shapes: DataFrame, models: DataFrame) -> DataFrame:
    """Adds each share's predicted cost and whether its rank permits it. Models are one row a rank."""
    rows = shapes.join(F.broadcast(models), "rank")
    cost = rank_cost("count", "width", "quadratic", "linear", "overhead")
    return rows.withColumns({"cost": cost, "permitted": permits("count", "width", "max_samples", "max_padded_tokens", "max_attention_cells")})


def objective(costs: DataFrame) -> DataFrame:
    return costs.groupBy("step").agg(F.max("cost").alias("makespan"), F.sum("cost").alias("total"), F.count(F.lit(1)).alias("ranks"), F.bool_and("permitted").alias("feasible"))


def lower_bounds(plan: DataFrame, models: DataFrame, length: str = "length") -> DataFrame:
    """(step, lower_bound): infinite where a sample fits nowhere. Samples meet the few models as an array in their own row."""
    fields = [c for c in models.columns if c != "rank"]
    one = models.agg(F.collect_list(F.struct(*fields)).alias("_models"), F.count(F.lit(1)).alias("_world"), F.sum("overhead").alias("_overhead"))
    w = (F.col(length) - 1).cast("double")
    fits = F.filter("_models", lambda m: permits(F.lit(1), F.col(length) - 1, m["max_samples"], m["max_padded_tokens"], m["max_attention_cells"]))
    rows = plan.join(F.broadcast(one)).withColumn("_fits", fits)
    alone = F.array_min(F.transform("_fits", lambda m: m["quadratic"] * w * w + m["linear"] * w + m["overhead"]))
    work = F.array_min(F.transform("_fits", lambda m: m["quadratic"] * w * w + m["linear"] * w))
    sums = rows.withColumns({"_alone": alone, "_work": work}).groupBy("step", "_world", "_overhead").agg(F.max("_alone").alias("a"), F.sum("_work").alias("b"), F.count_if(F.col("_alone").isNull()).alias("unfit"))
    bound = F.when(F.col("unfit") > 0, F.lit(float("inf"))).otherwise(F.greatest("a", (F.col("b") + F.col("_overhead")) / F.col("_world")))
    return sums.select("step", bound.alias("lower_bound"))


def certificates(plan: DataFrame, models: DataFrame, length: str = "length") -> DataFrame:
    """(step, sample_count, global_tokens, makespan, total, lower_bound, bound_gap, feasible) of each step."""
    shapes = with_models(group_shapes(plan, length), models)
    sums = shapes.groupBy("step").agg(F.sum("count").alias("sample_count"), F.sum("tokens").alias("global_tokens"), F.max("cost").alias("makespan"), F.sum("cost").alias("total"), (F.bool_and("permitted") & (F.count(F.lit(1)) == F.lit(models.count()))).alias("feasible"))
    return sums.join(lower_bounds(plan, models, length), "step").withColumn("bound_gap", F.col("makespan") / F.col("lower_bound") - 1)


def lost_samples(batch: DataFrame, plan: DataFrame, key: str = "id") -> DataFrame:
    """(step, id, n) where the plan and the batch hold a sample a different number of times; one aggregation, no join."""
    both = batch.select("step", key, F.lit(1).alias("d")).union(plan.select("step", key, F.lit(-1).alias("d")))
    return both.groupBy("step", key).agg(F.sum("d").alias("n")).filter("n != 0")


def _searched(plan: DataFrame, columns: str, body) -> DataFrame:
    """A search a step: batches are small by nature and independent, so steps are the unit of parallel work."""
    return plan.select("step", "rank", "pos", "id", "length").groupBy("step").applyInPandas(body, columns)


def balanced_plan(plan: DataFrame, world: int, batch: int) -> DataFrame:
    """(step, rank, pos, id, length) after balancing the padded proxy of each dealt step."""

    def body(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "pos"])
        length = dict(zip(rows["id"].tolist(), rows["length"].tolist(), strict=True))
        step = int(rows["step"].iloc[0])
        groups = search.balanced_layout(rows["id"].tolist(), rows["length"].tolist(), world, batch, step)
        return pd.DataFrame([(step, r, k, i, length[i]) for r, g in enumerate(groups) for k, i in enumerate(g)], columns=["step", "rank", "pos", "id", "length"])

    return _searched(plan, "step long, rank long, pos long, id long, length long", body)


def fleet_plan(plan: DataFrame, models: list[dict], local_rounds: int = 12, beam_width: int = 64, keep_local: bool = True) -> DataFrame:
    """(step, rank, pos, id, length) scheduled for ranks of different speed and room; ranks keep their place.

    A step without a feasible layout found has no rows; `plan_statuses` names it.
    """

    def body(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "pos"])
        length = dict(zip(rows["id"].tolist(), rows["length"].tolist(), strict=True))
        step = int(rows["step"].iloc[0])
        try:
            groups = search.schedule(rows["id"].tolist(), rows["length"].tolist(), models, local_rounds, beam_width, keep_local)
        except ValueError:
            groups = []
        return pd.DataFrame([(step, r, k, i, length[i]) for r, g in enumerate(groups) for k, i in enumerate(g)], columns=["step", "rank", "pos", "id", "length"])

    return _searched(plan, "step long, rank long, pos long, id long, length long", body)


def plan_statuses(dealt: DataFrame, plan: DataFrame) -> DataFrame:
    """(step, status) of every dealt step: "planned", or "infeasible" where no layout was found."""
    planned = plan.select("step").distinct().withColumn("found", F.lit(True))
    steps = dealt.select("step").distinct().join(planned, "step", "left")
    return steps.select("step", F.when(F.col("found"), "planned").otherwise("infeasible").alias("status"))


def checked_domains(plan: DataFrame, ranks: DataFrame) -> DataFrame:
    """The same plan; one with a group outside of what its rank was calibrated for is refused, and its ranks are named."""
    bad = fleet.domain_violations(group_shapes(plan), ranks)
    told = bad.groupBy("rank", "reason").agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("groups")).orderBy("rank", "reason").limit(search.MAX_RANKS).collect()
    require(not told, "planned shapes lie outside of the profile's domains: " + "; ".join(f"rank {r['rank']}: {r['reason']} in {r['groups']} groups, first in step {r['step']}" for r in told))
    return plan


def profiled_plan(plan: DataFrame, profile: DataFrame, **options) -> DataFrame:
    """A dealt plan scheduled for the ranks of one profile (a row of `fleet.load_profiles`), refused where a step has no
    layout or a group lies outside of its rank's domain. The plan is a table by then, so checking doesn't search again."""
    require(len(profile.select("sha256").limit(2).collect()) == 1, "a plan needs one profile")
    ranks = fleet.rank_models(profile, "sha256")
    models = [r.asDict() for r in ranks.select([f.name for f in RANK_MODEL.fields]).orderBy("rank").limit(search.MAX_RANKS + 1).collect()]
    require(plan.filter(~F.col("rank").between(0, len(models) - 1)).isEmpty(), "fleet mode needs a model for each rank")
    made = scratch.stored(fleet_plan(plan, models, **options), "plan")
    lost = plan_statuses(plan, made).filter("status <> 'planned'").agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("n")).first()
    require(not lost["n"], f"no feasible layout for {lost['n']} steps, first for step {lost['step']}")
    return checked_domains(made, ranks)


def exact_plan(plan: DataFrame, models: list[dict], node_budget: int = 100_000) -> DataFrame:
    """(step, status, nodes, makespan, lower_bound) of the exact search of each step."""

    def body(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "pos"])
        got = search.solve_exact(rows["id"].tolist(), rows["length"].tolist(), models, node_budget)
        return pd.DataFrame([(int(rows["step"].iloc[0]), got["status"], got["nodes"], got["upper_bound"], got["lower_bound"])], columns=["step", "status", "nodes", "makespan", "lower_bound"])

    return _searched(plan, "step long, status string, nodes long, makespan double, lower_bound double", body)
