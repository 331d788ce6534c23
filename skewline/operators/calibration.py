"""Cost-model calibration: median replicates, Gram matrix, non-negative least squares in closed form, held-out errors."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..guards import Rules, not_finite

FEATURES = ("quadratic", "linear", "overhead")
MIN_SHAPES = 8
PIVOT = 1e-10


def observation_rules() -> Rules:
    return {"batch": F.col("batch") < 1, "width": F.col("width") < 1, "ms": not_finite("ms") | (F.col("ms") <= 0)}


def medians(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rank", "batch", "width").agg(F.median("ms").alias("ms"))


def features(shapes: DataFrame) -> DataFrame:
    b, w = F.col("batch").cast("double"), F.col("width").cast("double")
    return shapes.withColumns({"x0": b * w * w, "x1": b * w, "x2": F.lit(1.0)})


def gram(shapes: DataFrame) -> DataFrame:
    """(rank, n, s0..s2 scales, g00..g22 upper triangle, r0..r2, yy): the normal equations of features scaled to 1.

    Raw moments and scales are one aggregation; scaling is algebra on its row.
    """
    raw = features(shapes).groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(f"x{i}").alias(f"s{i}") for i in range(3)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(F.col(f"x{i}") * F.col("ms")).alias(f"r{i}") for i in range(3)],
        F.sum(F.col("ms") * F.col("ms")).alias("yy"),
    )
    scaled = {f"g{i}{j}": F.col(f"g{i}{j}") / (F.col(f"s{i}") * F.col(f"s{j}")) for i in range(3) for j in range(i, 3)}
    return raw.withColumns(scaled | {f"r{i}": F.col(f"r{i}") / F.col(f"s{i}") for i in range(3)})


def _g(i: int, j: int) -> Column:
    return F.col(f"g{min(i, j)}{max(i, j)}")


def _face(active: tuple[int, ...]) -> tuple[Column, list[Column]]:
    """(determinant, solution) of the normal equations on some features, by Cramer's rule."""
    m = [[_g(i, j) for j in active] for i in active]
    r = [F.col(f"r{i}") for i in active]
    if len(active) == 1:
        return m[0][0], [r[0] / m[0][0]]
    if len(active) == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return det, [(r[0] * m[1][1] - m[0][1] * r[1]) / det, (m[0][0] * r[1] - r[0] * m[1][0]) / det]

    def minor(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    det = minor(m)
    swapped = lambda k: [[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return det, [minor(swapped(k)) / det for k in range(3)]


def nonnegative_fit(shapes: DataFrame) -> DataFrame:
    """(rank, quadratic, linear, overhead, squared_error): the best of the seven faces with no negative coefficient."""
    rows = gram(shapes)
    candidates = []
    for k in (1, 2, 3):
        for active in itertools.combinations(range(3), k):
            det, solution = _face(active)
            full = [solution[active.index(i)] if i in active else F.lit(0.0) for i in range(3)]
            c = [F.greatest(F.lit(0.0), x) for x in full]
            error = F.col("yy") - 2 * sum((c[i] * F.col(f"r{i}") for i in range(3)), F.lit(0.0)) + sum((c[i] * c[j] * _g(i, j) for i in range(3) for j in range(3)), F.lit(0.0))
            fits = F.abs(det) >= PIVOT
            for x in solution:
                fits = fits & (x >= -1e-9)
            candidates.append(F.when(fits, F.struct(F.greatest(error, F.lit(0.0)).alias("error"), F.lit(len(candidates)).alias("face"), *[(c[i] / F.col(f"s{i}")).alias(FEATURES[i]) for i in range(3)])))
    best = F.array_min(F.array_compact(F.array(*candidates)))
    return rows.select("rank", best.alias("best")).select("rank", *[f"best.{f}" for f in FEATURES], F.col("best.error").alias("squared_error"))


def domains(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rank").agg(*[f(c).alias(f"{n}_{c}") for c in ("batch", "width") for n, f in (("min", F.min), ("max", F.max))])


def errors(shapes: DataFrame, fits: DataFrame) -> DataFrame:
    """(rank, shapes, median_relative_error, max_relative_error, rmse_ms) of predictions on given shapes."""
    rows = features(shapes).join(fits, "rank")
    predicted = F.col("quadratic") * F.col("x0") + F.col("linear") * F.col("x1") + F.col("overhead")
    relative = F.abs(predicted / F.col("ms") - 1)
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("shapes"), F.median(relative).alias("median_relative_error"), F.max(relative).alias("max_relative_error"), F.sqrt(F.avg(F.pow(predicted - F.col("ms"), F.lit(2)))).alias("rmse_ms"))


def held_out(shapes: DataFrame, seed: int = 17) -> DataFrame:
    """Marks max(2, n / 4) shapes of each rank, those of smallest hash, as held out; the rest is for fitting."""
    from pyspark.sql import Window

    order = Window.partitionBy("rank").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "batch", "width").cast("binary")))
    n = F.count(F.lit(1)).over(Window.partitionBy("rank"))
    return shapes.withColumn("held_out", F.row_number().over(order) <= F.greatest(F.lit(2), F.floor(n / 4)))


def fit_ranks(rows: DataFrame, seed: int = 17) -> DataFrame:
    """A fitted model, its domain and its held-out errors for each rank with enough distinct shapes."""
    shapes = held_out(medians(rows), seed)
    fits = nonnegative_fit(shapes.filter("NOT held_out"))
    enough = shapes.groupBy("rank").count().filter(F.col("count") >= MIN_SHAPES).select("rank")
    good = fits.filter("quadratic + linear > 0").join(enough, "rank")
    return good.join(domains(rows), "rank").join(errors(shapes.filter("held_out"), fits), "rank").withColumn("max_samples", F.col("max_batch"))
