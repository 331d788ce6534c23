"""Fleet profiles, cost models and training settings, validated by rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..guards import Rules, not_finite, strict
from ..schemas import PROFILE

#: Settings that a calibration is valid for (fixed values).
WORKLOAD = ("width", "heads", "layers", "vocab_size", "max_length", "kernel", "precision", "activation_checkpointing", "device", "threads")
HARDWARE = ("source_sha256", "hostname", "platform", "torch", "gpu", "cuda_runtime", "device")
#: Choices of the named settings (fixed values).
CHOICES = {"strategy": ("single", "ddp", "fsdp2"), "planner": ("random", "balanced", "fleet"), "kernel": ("reference", "cuda"), "device": ("cpu", "cuda"), "precision": ("fp32", "bf16")}
DOMAIN_FIELDS = ("min_batch", "max_batch", "min_width", "max_width")
#: What a model is without its coefficients (fixed values).
COEFFICIENTS = {"quadratic": 1.0, "linear": 0.0, "overhead": 0.0}
MAX_SAMPLES = 8
POSITIVE = ("samples", "min_length", "max_length", "batch_size", "steps", "width", "heads", "layers", "vocab_size", "bucket_cap_mb", "profile_steps", "threads")


def model_rules() -> Rules:
    """Bad rows of rank models."""
    coefficients = {c: not_finite(F.col(c).cast("double")) | (F.col(c) < 0) for c in ("quadratic", "linear", "overhead")}
    caps = {c: F.coalesce(F.col(c) < 1, F.lit(False)) for c in ("max_padded_tokens", "max_attention_cells")}
    return {**coefficients, "no work": F.col("quadratic") + F.col("linear") <= 0, "max_samples": F.coalesce(F.col("max_samples") < 1, F.lit(True)), **caps}


def config_rules() -> Rules:
    """Bad rows of training settings."""
    c = F.col
    return {
        **{n: c(n) <= 0 for n in POSITIVE},
        "seed": (c("seed") < 0) | (c("seed") >= 2**31),
        "lr": not_finite("lr") | (c("lr") <= 0),
        "delay_ms": not_finite("delay_ms") | (c("delay_ms") < 0),
        "lengths": (c("min_length") < 2) | (c("max_length") < c("min_length")),
        "heads divide width": c("width") % F.nullif("heads", F.lit(0)) != 0,
        "warmup": (c("warmup") < 0) | (c("warmup") >= c("steps")),
        "checkpoint_every": c("checkpoint_every") < 0,
        "metrics_flush_every": c("metrics_flush_every") < 0,
        **{n: ~c(n).isin(*v) for n, v in CHOICES.items()},
        "fsdp2 needs cuda": (c("strategy") == "fsdp2") & (c("device") != "cuda"),
        "cuda kernel needs cuda": (c("kernel") == "cuda") & (c("device") != "cuda"),
        "fleet path": (c("planner") == "fleet") != (F.coalesce(F.length("fleet_path"), F.lit(0)) > 0),
        "dataset path": F.coalesce((F.length("dataset_path") == 0) | (c("vocab_size") != 256), F.lit(False)),
    }


def profile_rules() -> Rules:
    """Bad rows of profiles: (schema_version, evidence, units, scope, workload, n_hardware, n_ranks)."""
    observed = F.col("evidence") == "observed_isolated"
    return {
        "schema": F.col("schema_version") != 1,
        "evidence": ~F.col("evidence").isin("declared", "observed_isolated"),
        "units": ~F.col("units").isin("proxy", "ms"),
        "ranks": F.coalesce(F.col("n_ranks") < 1, F.lit(True)),
        "observed scope": observed & ~((F.col("units") == "ms") & F.coalesce(F.col("scope") == "forward_backward_no_collectives", F.lit(False)) & F.col("workload").isNotNull() & (F.coalesce("n_hardware", F.lit(0)) > 0)),
        "observed hardware": observed & (F.coalesce("n_hardware", F.lit(0)) != F.col("n_ranks")),
    }


def workload_signature(config: dict[str, Column]) -> Column:
    return F.struct(*[config[k].alias(k) for k in WORKLOAD])


def hardware_changes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(rank, changed array<string>) of ranks whose machine or software isn't the calibrated one."""
    a, b = recorded.alias("a"), current.alias("b")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in HARDWARE]))
    return a.join(b, F.col("a.rank") == F.col("b.rank"), "left").select(F.col("a.rank").alias("rank"), changed.alias("changed")).filter(F.size("changed") > 0)


def outside_domain(groups: DataFrame, domains: DataFrame) -> DataFrame:
    """Planned groups (rank, count, width) outside of what their rank was calibrated for."""
    rows = groups.join(F.broadcast(domains), "rank")
    return rows.filter(~(F.col("count").between(F.col("min_batch"), F.col("max_batch")) & F.col("width").between(F.col("min_width"), F.col("max_width"))))


@F.pandas_udf(StringType())
def canonical_text(documents: pd.Series) -> pd.Series:
    """JSON with sorted names and no blanks, as its hash is taken; numbers that JSON doesn't know are refused. Null stays null."""

    def one(text):
        if text is None:
            return None
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), allow_nan=False)

    return documents.map(one)


def parsed_profiles(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `canonical`, `sha256` and the fields of a profile to `documents`; names that a profile doesn't have are part of its hash alone."""
    rows = documents.withColumn("canonical", canonical_text(text))
    rows = rows.withColumns({"sha256": F.sha2(F.col("canonical").cast("binary"), 256), "_p": F.from_json("canonical", PROFILE, {"mode": "FAILFAST"})})
    return rows.select(*[c for c in documents.columns if c != text], "canonical", "sha256", "_p.*")


def load_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, canonical, sha256, schema_version, evidence, units, scope, workload, hardware, ranks) of files; a bad one fails the query that reads it."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return checked_profiles(parsed_profiles(files))


def counted(profiles: DataFrame) -> DataFrame:
    """Profiles with the numbers that `profile_rules` asks for."""
    return profiles.withColumns({"n_hardware": F.coalesce(F.size("hardware"), F.lit(0)), "n_ranks": F.coalesce(F.size("ranks"), F.lit(0))})


def checked_profiles(profiles: DataFrame) -> DataFrame:
    bad = F.exists("ranks", lambda r: r["model"].isNull())
    return strict(counted(profiles), {**profile_rules(), "rank without a model": F.coalesce(bad, F.lit(True))}).drop("n_hardware", "n_ranks")


def rank_models(profiles: DataFrame, key: str = "path") -> DataFrame:
    """A row a rank: (key, evidence, rank, the model's fields, the domain's fields); bad models fail. Absent coefficients are the defaults."""
    rows = profiles.select(key, "evidence", F.posexplode("ranks").alias("rank", "r"))
    model = [F.coalesce(F.col(f"r.model.{name}"), F.lit(default).cast("double")).alias(name) for name, default in COEFFICIENTS.items()]
    caps = [F.coalesce("r.model.max_samples", F.lit(MAX_SAMPLES).cast("long")).alias("max_samples"), "r.model.max_padded_tokens", "r.model.max_attention_cells"]
    return strict(rows.select(key, "evidence", F.col("rank").cast("long").alias("rank"), *model, *caps, *[f"r.domain.{c}" for c in DOMAIN_FIELDS], F.col("r.domain").isNotNull().alias("has_domain")), model_rules())


def profile_summaries(profiles: DataFrame, key: str = "path") -> DataFrame:
    """(key, sha256, evidence, units, scope, ranks) as runs record of their fleet."""
    return profiles.select(key, "sha256", "evidence", "units", F.coalesce("scope", F.lit("declared_compute_proxy")).alias("scope"), "ranks")


def use_rules() -> Rules:
    """Bad uses: rows of (evidence, workload, n_ranks) of a profile and (world_size, strategy, signature) of the run, signatures as canonical JSON."""
    observed = F.col("evidence") == "observed_isolated"
    return {
        "rank count": F.col("n_ranks") != F.col("world_size"),
        "workload": observed & ~F.col("workload").eqNullSafe(F.col("signature")),
        "sharded run of an isolated calibration": observed & (F.col("strategy") == "fsdp2"),
    }


def domain_violations(shapes: DataFrame, ranks: DataFrame) -> DataFrame:
    """(step, rank, count, width, reason) of planned groups that their rank's model doesn't tell of.

    `ranks`: (rank, evidence, min_batch, max_batch, min_width, max_width), a row a rank, all null for no domain. A declared model
    without a domain permits every shape, an observed one none. A rank that the profile lacks is named too.
    """
    known = ranks.select("rank", "evidence", *DOMAIN_FIELDS)
    rows = shapes.select("step", "rank", "count", "width").join(known, "rank", "left")
    none = F.coalesce(*[F.col(c).cast("long") for c in DOMAIN_FIELDS]).isNull()
    inside = lambda c, lo, hi: F.coalesce(F.col(c).between(F.col(lo), F.col(hi)), F.lit(False))
    reason = (
        F.when(F.col("evidence").isNull(), "rank not in the profile")
        .when(none & (F.col("evidence") == "observed_isolated"), "no domain")
        .when(none, F.lit(None).cast("string"))
        .when(~inside("count", "min_batch", "max_batch"), "batch")
        .when(~inside("width", "min_width", "max_width"), "width")
    )
    return rows.select("step", "rank", "count", "width", reason.alias("reason")).filter("reason IS NOT NULL")
