"""Paired experiments: protocol rules, speedups by seed, geometric mean, bootstrap interval and verdict."""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uniform_draw, verdict
from ..guards import Rules, require, violations
from ..sources import files
from .metrics import run_summary

#: Settings that an experiment may change between its arms (fixed values).
INTERVENTIONS = ("fleet_path", "planner", "kernel", "bucket_cap_mb", "activation_checkpointing", "strategy", "precision")
MIN_PAIRS = 3
RESAMPLES = 4000
HARDWARE = ("hostname", "platform", "torch", "gpu", "cuda_runtime", "backend", "source_sha256")


def paired_speedups(steps: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(seed, baseline_ms, candidate_ms, speedup): medians of both arms side by side, by one aggregation and no join."""
    median = lambda arm: F.median(F.when(F.col("arm") == arm, F.col("step_ms")))
    pairs = steps.filter(F.col("arm").isin(baseline, candidate)).groupBy("seed").agg(median(baseline).alias("baseline_ms"), median(candidate).alias("candidate_ms"))
    return pairs.filter("baseline_ms IS NOT NULL AND candidate_ms IS NOT NULL").withColumn("speedup", F.col("baseline_ms") / F.col("candidate_ms"))


def geometric_mean(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.exp(F.avg(F.ln("speedup"))).alias("geometric_mean_speedup"))


def bootstrap_interval(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 19) -> DataFrame:
    """(pairs, geometric_mean_speedup, lo, hi, verdict) over resampled seeds, drawn by a hash that any engine can repeat.

    The pairs are one array, a number a seed; resamples are rows, and draws are a loop inside the row.
    """
    require(resamples >= 100, "a bootstrap needs at least 100 resamples")
    one = pairs.agg(F.sort_array(F.collect_list(F.struct("seed", F.ln("speedup").alias("log")))).alias("logs"), F.count(F.lit(1)).alias("pairs"), F.exp(F.avg(F.ln("speedup"))).alias("geometric_mean_speedup"))
    draws = one.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    pick = lambda i: F.get("logs", F.floor(uniform_draw(F.lit(seed), F.col("replicate"), i) * F.col("pairs")).cast("int"))["log"]
    mean = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1), F.lit(0.0), lambda s, i: s + pick(i)) / F.col("pairs")
    samples = draws.select("pairs", "geometric_mean_speedup", F.exp(mean).alias("value"))
    out = samples.groupBy("pairs", "geometric_mean_speedup").agg(F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"))
    enough = F.col("pairs") >= MIN_PAIRS
    out = out.withColumns({"lo": F.when(enough, F.col("lo")), "hi": F.when(enough, F.col("hi"))})
    return out.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def quantile(values: list[float], q: float) -> float:
    ordered = sorted(values)
    at = (len(ordered) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return ordered[lo] * (1 - (at - lo)) + ordered[hi] * (at - lo) if lo != hi else ordered[lo]


def seeded_interval(speedups: list[float], resamples: int = RESAMPLES, seed: int = 19) -> tuple[float, float] | None:
    """The interval drawn with Python's generator, for results that published runs recorded; pairs are few by nature."""
    require(resamples >= 100, "a bootstrap needs at least 100 resamples")
    if len(speedups) < MIN_PAIRS:
        return None
    logs, rng = [math.log(s) for s in speedups], random.Random(seed)
    means = [math.exp(statistics.mean(rng.choices(logs, k=len(logs)))) for _ in range(resamples)]
    return quantile(means, 0.025), quantile(means, 0.975)


def protocol_rules() -> Rules:
    """Bad pairs of manifests; the rows hold `a` and `b` (structs of a manifest each) and `hash_a`, `hash_b`."""
    a, b = F.col("a"), F.col("b")
    differs = lambda *path: ~_get(a, path).eqNullSafe(_get(b, path))
    return {
        "evidence": ~((a["evidence"] == "observed") & (b["evidence"] == "observed")),
        "world size": differs("world_size"),
        "timing": differs("timing"),
        "start step": differs("start_step"),
        "resume": differs("resume"),
        "instrumented": differs("instrumented"),
        "configuration schema": F.sort_array(F.map_keys(a["config"])) != F.sort_array(F.map_keys(b["config"])),
        "intervention": (F.size(changed_keys()) == 0) | (F.size(F.array_except(changed_keys(), F.array(*map(F.lit, INTERVENTIONS)))) > 0),
        "fleet hash": _lacks(a, "planner", "fleet", "fleet") | _lacks(b, "planner", "fleet", "fleet"),
        "dataset hash": _lacks(a, "dataset_path", None, "dataset") | _lacks(b, "dataset_path", None, "dataset"),
        "dataset": ~_map_text(a["dataset"]).eqNullSafe(_map_text(b["dataset"])),
        "hardware": _topology(a) != _topology(b),
        "workload": F.col("hash_a") != F.col("hash_b"),
    }


def provenance_rules() -> Rules:
    """Bad pairs by what their journals tell: `within_a`, `within_b`, null where a run has none, say that ranks wrote before their end.

    Writing takes time from steps, so both runs of a pair must have done it or neither, and a manifest must own up to it.
    """
    return {
        "one run wrote within": F.coalesce(F.col("within_a") != F.col("within_b"), F.lit(False)),
        **{f"{side} is not instrumented as its journals tell": F.coalesce(F.col(f"within_{s}") & ~F.coalesce(F.col(s)["instrumented"], F.lit(False)), F.lit(False)) for side, s in (("baseline", "a"), ("candidate", "b"))},
    }


def _get(manifest, path):
    for name in path:
        manifest = manifest[name]
    return manifest


def _lacks(manifest, key, value, recorded):
    given = F.get(F.map_values(F.map_filter(manifest["config"], lambda k, v: k == key)), F.lit(0))
    used = given.isNotNull() & (F.lower(given) != "null") if value is None else given == value
    known = F.get(F.map_values(F.map_filter(F.coalesce(manifest[recorded], F.create_map().cast("map<string,string>")), lambda k, v: k == "sha256")), F.lit(0))
    return F.coalesce(used, F.lit(False)) & known.isNull()


def _map_text(m):
    return F.to_json(F.array_sort(F.map_entries(m)))


def _topology(manifest):
    ranks = F.array_sort(F.transform(manifest["hardware"], lambda h: F.struct(h["rank"].alias("rank"), *[h[k].alias(k) for k in HARDWARE])))
    return F.to_json(F.transform(ranks, lambda h: h.dropFields("rank")))


def changed_keys():
    """Sorted names of settings that differ between the two manifests of a pair."""
    a, b = F.col("a")["config"], F.col("b")["config"]
    return F.sort_array(F.filter(F.map_keys(a), lambda k: ~F.element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def paired_runs(spark: SparkSession, pairs: list[tuple[str, str]], runs: dict[str, DataFrame], within: Mapping[str, bool | None]) -> DataFrame:
    """(pair, baseline, candidate, a, b, hash_a, hash_b, ms_a, ms_b, within_a, within_b): manifests, summaries and journals' provenance of each pair."""
    sides = []
    for name, (side, hash_, ms, wrote) in (("baseline", ("a", "hash_a", "ms_a", "within_a")), ("candidate", ("b", "hash_b", "ms_b", "within_b"))):
        parts = []
        for i, pair in enumerate(pairs):
            path = pair[name == "candidate"]
            manifest = files.manifests(spark, f"{path}/{files.MANIFEST_FILE}")
            told = manifest.select(F.lit(i).alias("pair"), F.lit(path).alias(name), F.lit(within.get(path)).cast("boolean").alias(wrote), "run", F.struct(*[c for c in manifest.columns if c != "run"]).alias(side))
            parts.append(told.join(run_summary(runs[path]).select("run", F.col("workload_sha256").alias(hash_), F.col("median_step_ms").alias(ms)), "run", "left").drop("run"))
        sides.append(reduce(DataFrame.unionByName, parts))
    return sides[0].join(sides[1], "pair")


def pair_report(pairs: DataFrame, resamples: int = RESAMPLES) -> dict:
    """The comparison of few pairs of runs; refused unless each pair and all of them together follow the protocol."""
    pairs = pairs.withColumns({"changed": changed_keys(), "seed": F.element_at(F.col("a")["config"], "seed")}).cache()
    bad = [(r["pair"], r["rule"]) for r in violations(pairs, {**protocol_rules(), **provenance_rules()}).select("pair", "rule").orderBy("pair", "rule").collect()]
    require(not bad, f"pairs break the protocol: {bad}")
    rows = pairs.select("pair", "seed", "baseline", "candidate", "ms_a", "ms_b", "changed", F.struct(_fixed("a"), _fixed("b")).alias("fixed")).orderBy("pair").collect()
    require(len({r["seed"] for r in rows}) == len(rows), "independent pairs must use distinct seeds")
    require(len({tuple(r["changed"]) for r in rows}) == 1 and len({r["fixed"] for r in rows}) == 1, "all pairs must make the same intervention")
    speedups = [r["ms_a"] / r["ms_b"] for r in rows]
    interval = seeded_interval(speedups, resamples)
    lo, hi = interval or (None, None)
    says = pairs.sparkSession.range(1).select(verdict(F.lit(lo).cast("double"), F.lit(hi).cast("double"))).first()[0]
    return {
        "intervention": rows[0]["changed"],
        "pairs": [{"seed": r["seed"], "baseline": r["baseline"], "candidate": r["candidate"], "baseline_median_ms": r["ms_a"], "candidate_median_ms": r["ms_b"], "speedup": s} for r, s in zip(rows, speedups, strict=True)],
        "geometric_mean_speedup": math.exp(statistics.fmean(map(math.log, speedups))),
        "seed_bootstrap_95_ci": interval and list(interval),
        "verdict": says,
    }


def _fixed(side: str) -> Column:
    """A manifest's settings but the seed, which all pairs of a comparison share."""
    return _map_text(F.map_filter(F.col(side)["config"], lambda k, _: k != "seed")).alias(side)
