"""Generated inputs: lengths, metric fixtures, a demo trace, padded token batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import padded, uniform_draw


def log_uniform_lengths(spark: SparkSession, samples: int, least: int, most: int, seed: int = 17) -> DataFrame:
    """(id, length): exp of a uniform draw between the logs of the bounds, rounded half to even and clamped."""
    draw = uniform_draw(F.lit(seed), F.col("id"))
    value = F.bround(F.exp(F.lit(math.log(least)) + draw * (math.log(most) - math.log(least)))).cast("long")
    return spark.range(samples).select("id", F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), value)).alias("length"))


def metric_fixture(spark: SparkSession, steps: int, ranks: int = 2) -> DataFrame:
    """Rank metrics of a run whose figures follow from step and rank."""
    rows = spark.range(steps * ranks).select(F.lit("fixture").alias("run"), (F.col("id") % ranks).alias("rank"), F.floor(F.col("id") / ranks).alias("step"))
    return rows.select(
        "run",
        "rank",
        "step",
        F.lit(False).alias("warmup"),
        F.lit(4).cast("long").alias("local_tokens"),
        F.lit(4 * ranks).cast("long").alias("global_tokens"),
        F.lit(5).cast("long").alias("padded_tokens"),
        (1 + ((17 * F.col("step") + 3 * F.col("rank")) % 101) / 7).alias("step_ms"),
        F.lit(8.0).alias("loss_sum"),
        F.lit(0).cast("long").alias("peak_memory_bytes"),
        (4 + F.col("rank")).cast("double").alias("predicted_cost"),
    )


def demo_trace(spark: SparkSession) -> DataFrame:
    """A step window with two kernels and a collective that overlap, and a host event that doesn't count."""
    rows = [("train/step/0", "user_annotation", 0.0, 10000.0), ("gemm", "kernel", 0.0, 6000.0), ("gemm2", "kernel", 2000.0, 3000.0), ("ncclAllReduce", "kernel", 4000.0, 4000.0), ("launch", "cuda_runtime", 0.0, 9000.0)]
    values = ", ".join(f"('X', '{n}', '{c}', {t}D, {d}D)" for n, c, t, d in rows)
    return spark.sql(f"SELECT ph, name, cat, ts, dur, 0L AS pid, 0L AS tid, named_struct('device', CASE WHEN cat = 'kernel' THEN 0L END) AS args FROM VALUES {values} AS t(ph, name, cat, ts, dur)")


def batch_tokens(samples: DataFrame, length: int, vocabulary: int, seed: int = 17) -> DataFrame:
    """(id, tokens, targets): tokens drawn by sample id, filled up with 0; targets are the next tokens, filled up with -100."""
    draw = F.transform(F.sequence(F.lit(0), (F.col("length") - 1).cast("int")), lambda i: F.floor(uniform_draw(F.lit(seed), F.col("id"), i) * vocabulary).cast("int"))
    rows = samples.withColumn("_t", draw)
    n = F.size("_t")
    return rows.select("id", padded(F.slice("_t", 1, n - 1), length, 0).alias("tokens"), padded(F.slice("_t", 2, n), length, -100).alias("targets"))
