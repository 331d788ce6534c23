"""Exact order statistics of groups of any size: a sketch tells a narrow range of values, and only that is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..guards import require
from ..sources.scratch import stored

#: A range of so many rows, alike ones counted once, is sorted in one task.
ENOUGH = 200_000
GRID = 256
ACCURACY = 10_000
ROUNDS = 8
#: Ranges up to this number are broadcast; each has some 100 bytes.
BROADCAST_ROWS = 100_000


def order_statistics(rows: DataFrame, places: DataFrame, group: str, value: str, enough: int = ENOUGH) -> DataFrame:
    """(group, place, value): the value that has `place` values before it in its group, for each row of `places` (group, place).

    In every round each range's values are counted below and within three cells of a sketch's grid around the place; the cells
    become the range if they hold the place, which the counts decide and not the sketch. What is left is counted by value
    and summed up. All passes combine on the map side; joins have one row a place on one side, so a hot group can be split.
    """
    rows = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_in"))
    ranges = places.select(F.col(group).alias("_g"), "place").distinct().join(ends, "_g").withColumn("_below", F.lit(0).cast("long"))
    ranges = stored(ranges.filter("place >= 0 AND place < _in"))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    for _ in range(ROUNDS):
        wide = ranges.filter((F.col("_in") > enough) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        within = _within(rows, wide)
        sketch = within.groupBy("_g", "place").agg(F.percentile_approx("_v", grid, F.lit(ACCURACY)).alias("_cells"))
        at = F.floor((F.col("place") - F.col("_below")) * GRID / F.col("_in"))
        cell = lambda i: F.element_at("_cells", F.greatest(F.lit(1), F.least(F.lit(GRID + 1), i)).cast("int"))
        cut = stored(wide.join(sketch, ["_g", "place"]).withColumns({"_from": cell(at), "_to": cell(at + 3)}).drop("_cells"))
        counts = _within(rows, cut).groupBy("_g", "place").agg(F.count_if(F.col("_v") < F.col("_from")).alias("_less"), F.count_if((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))).alias("_same"))
        found = cut.join(counts, ["_g", "place"])
        rest = F.col("place") - F.col("_below")
        low, high = rest >= F.col("_less"), rest < F.col("_less") + F.col("_same")
        narrow = found.select(
            "_g",
            "place",
            F.when(low, F.col("_from")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(high, F.col("_to")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(low & high, F.col("_same")).when(low, F.col("_in") - F.col("_less")).otherwise(F.col("_less") + F.col("_same")).alias("_in"),
            (F.col("_below") + F.when(low, F.col("_less")).otherwise(F.lit(0))).alias("_below"),
        )
        kept = ranges.filter(~((F.col("_in") > enough) & (F.col("_lo") < F.col("_hi"))))
        ranges = stored(kept.select(narrow.columns).unionByName(narrow))
    one = ranges.filter("_lo = _hi").select("_g", "place", F.col("_lo").alias("value"))
    counted = _within(rows, ranges.filter("_lo < _hi")).groupBy("_g", "place", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy("_g", "place").orderBy("_v"))
    some = counted.withColumn("_upto", upto).filter("_upto > place").groupBy("_g", "place").agg(F.min("_v").alias("value"))
    return one.unionByName(some).withColumnRenamed("_g", group)


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of each range. A place's own ends differ, so ranges are joined by group and then compared."""
    side = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    return rows.join(side, "_g").filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def quantiles(rows: DataFrame, group: str, value: str, points: tuple[float, ...], enough: int = ENOUGH) -> DataFrame:
    """(group, q, value) by linear interpolation between the two values around the place, for each of `points`; nulls don't count."""
    require(all(0 <= q <= 1 for q in points), "quantiles lie between 0 and 1")
    counts = rows.groupBy(group).agg(F.count(value).alias("_n")).filter("_n > 0")
    wanted = counts.select(group, F.explode(F.array(*[F.lit(float(q)) for q in points])).alias("q"), "_n").withColumn("_at", (F.col("_n") - 1) * F.col("q"))
    wanted = stored(wanted.select(group, "q", "_at", F.floor("_at").alias("_low"), F.ceil("_at").alias("_high")))
    places = wanted.select(group, F.explode(F.array("_low", "_high")).alias("place"))
    values = stored(order_statistics(rows, places, group, value, enough))
    named = lambda place, name: values.select(group, F.col("place").alias(place), F.col("value").alias(name))
    both = wanted.join(named("_low", "_a"), [group, "_low"]).join(named("_high", "_b"), [group, "_high"])
    return both.select(group, "q", _between(F.col("_a"), F.col("_b"), F.col("_at") - F.col("_low"), F.col("q")).alias("value"))


def _between(a: Column, b: Column, part: Column, q: Column) -> Column:
    return F.when(q == 0.5, F.when(part == 0, a).otherwise((a + b) / 2)).otherwise(a + (b - a) * part)
