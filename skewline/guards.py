"""Validation as data: a guard is a named predicate of a bad row; lenient use lists violations, strict use fails the query."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def broken(rules: Rules) -> Column:
    """array<string> of the rules that a row breaks; a predicate that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows with a `rule` column, one a broken rule; rows that break none are gone before anything is shuffled."""
    return df.withColumn("rule", F.explode(broken(rules)))


def violation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, n) of every rule, broken or not, in one aggregation."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def strict(df: DataFrame, rules: Rules) -> DataFrame:
    """The same rows; reading a bad one raises, in the same job that uses it."""
    bad = broken(rules)
    check = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("broken rules: "), F.array_join(bad, ", "), F.lit(" in "), F.to_json(F.struct(*df.columns))))).otherwise(F.lit(True))
    return df.filter(check)


def missing(df: DataFrame, columns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])


def not_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)
