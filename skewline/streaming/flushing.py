"""Bounded buffers of rank metrics on a stream: rows are held per rank and let go together, and what was let go is told.

A rank's rows leave its buffer when `every` of them are held (0: never for their number), when the oldest has waited for
`max_age_ms`, and with the run's last step, which also closes the rank. Rows that don't follow the rank's last one, or that
come after the end, are refused and come out marked so; nothing is lost in silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..guards import Rules, require

BY_ROWS, BY_AGE, AT_END, REFUSED = "rows", "age", "end", "refused"
FLUSHED = "run string, rank long, step long, payload string, flush long, reason string, complete boolean"


class BoundedBuffer(StatefulProcessor):
    """Per (run, rank): the steps and texts of held rows as a list, and a few numbers beside it.

    The list is read only when it is let go, so a batch that flushes nothing costs its own rows.
    """

    def __init__(self, every: int, max_age_ms: int | None):
        self.every, self.max_age_ms = every, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "step long, payload string")
        self.told = handle.getValueState("told", "held long, flushes long, next_step long, closed boolean, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = sorted((int(s), p, None if pd.isna(n) else int(n)) for f in rows for s, p, n in f[["step", "payload", "steps"]].itertuples(index=False))
        held, flushes, expected, closed, due = self.told.get() if self.told.exists() else (0, 0, None, False, None)
        fresh, out = [], []
        for step, payload, steps in batch:
            if closed or (expected is not None and step != expected) or (steps is not None and step >= steps):
                out.append((*key, step, payload, None, REFUSED, closed))
                continue
            expected = step + 1
            fresh.append((step, payload))
            closed = steps is not None and step + 1 == steps
            if closed or (self.every and held + len(fresh) >= self.every):
                out += self.let_go(key, held, fresh, flushes, AT_END if closed else BY_ROWS, closed)
                held, fresh, flushes = 0, [], flushes + 1
        if fresh:
            self.buffer.appendList(fresh)
            held += len(fresh)
        due = self.timer(held, due, timerValues)
        self.told.update((held, flushes, expected, closed, due))
        if out:
            yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, flushes, expected, closed, _ = self.told.get()
        if held:
            yield frame(self.let_go(key, held, [], flushes, BY_AGE, closed))
        self.told.update((0, flushes + (held > 0), expected, closed, None))

    def let_go(self, key, held: int, fresh: list, flush: int, reason: str, complete: bool) -> list[tuple]:
        kept = [tuple(r) for r in self.buffer.get()] if held else []
        self.buffer.clear()
        return [(*key, step, payload, flush, reason, complete) for step, payload in kept + fresh]

    def timer(self, held: int, due: int | None, values) -> int | None:
        """When the held rows are due: set with the first row that is held, gone with the last."""
        if self.max_age_ms is None or (held > 0) == (due is not None):
            return due
        if due is not None:
            self.handle.deleteTimer(due)
            return None
        due = values.getCurrentProcessingTimeInMs() + self.max_age_ms
        self.handle.registerTimer(due)
        return due

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["run", "rank", "step", "payload", "flush", "reason", "complete"]
    return pd.DataFrame(rows, columns=names, dtype=object)


def bounded_flush(rows: DataFrame, runs: DataFrame, every: int = 32, max_age_ms: int | None = None) -> DataFrame:
    """A stream's rows as they leave their buffers, with (flush, reason, complete); needs the RocksDB state store.

    `runs`: (run, steps), a table; a run that it doesn't name, or whose steps are null, has no end. Rows travel as texts, so
    nulls and longs stay exact. A refused row has a null `flush`. With `every` 0 a rank holds all its rows until its end
    or their age lets them go. With `max_age_ms` run the stream by a processing-time trigger. Rows of a null run or rank are a key of their own; a null step is refused by failing the query.
    """
    require(every >= 0 and (max_age_ms is None or max_age_ms > 0), "flush after a number of rows of 0 or more, and an age above 0")
    given = rows.select("run", "rank", F.assert_true(F.col("step").isNotNull(), "a row has no step").alias("_known"), "step", F.to_json(F.struct(*rows.columns)).alias("payload"))
    keyed = given.filter("_known IS NULL").join(runs.select("run", F.col("steps").cast("long").alias("steps")), "run", "left").select("run", "rank", "step", "steps", "payload")
    flushed = keyed.groupBy("run", "rank").transformWithStateInPandas(BoundedBuffer(every, max_age_ms), FLUSHED, "Append", "None" if max_age_ms is None else "ProcessingTime")
    return flushed.select(F.from_json("payload", rows.schema, {"mode": "FAILFAST"}).alias("row"), "flush", "reason", "complete").select("row.*", "flush", "reason", "complete")


def flush_history(flushed: DataFrame) -> DataFrame:
    """(run, rank, flushes, rows, refused, peak_buffered_rows, last_step, complete) of the rows that left their buffers.

    Two aggregations: sizes of flushes, then a rank's; the rows themselves are not collected.
    """
    kept = F.col("reason") != REFUSED
    sizes = flushed.groupBy("run", "rank", "flush").agg(F.count_if(kept).alias("n"), F.count_if(~kept).alias("refused"), F.max(F.when(kept, F.col("step"))).alias("last_step"), F.max(F.when(kept, F.col("complete"))).alias("complete"))
    return sizes.groupBy("run", "rank").agg(
        F.count("flush").alias("flushes"),
        F.sum("n").alias("rows"),
        F.sum("refused").alias("refused"),
        F.max("n").alias("peak_buffered_rows"),
        F.max("last_step").alias("last_step"),
        F.coalesce(F.max("complete"), F.lit(False)).alias("complete"),
    )


def telemetry(history: DataFrame) -> DataFrame:
    """(run, ranks, flushes, peak_buffered_rows, complete, flushed_within) of runs: the last tells that a rank wrote before its end."""
    return history.groupBy("run").agg(
        F.count(F.lit(1)).alias("ranks"),
        F.max("flushes").alias("flushes"),
        F.max("peak_buffered_rows").alias("peak_buffered_rows"),
        F.bool_and("complete").alias("complete"),
        F.bool_or(wrote_within()).alias("flushed_within"),
    )


def wrote_within() -> Column:
    """Whether a rank's journal was written while it still trained: more often than once, or once without having ended."""
    return (F.col("flushes") > 1) | ((F.col("flushes") == 1) & ~F.col("complete"))


def expected_flushes(rows: Column, every: Column) -> Column:
    """Flushes of a rank that ended after `rows` rows: one for each `every` of them, the rest with the end; 0 means the end alone."""
    return F.when(every > 0, F.ceil(rows / every)).otherwise(F.lit(1)).cast("long")


def history_rules(every: str = "flush_every") -> Rules:
    """Bad rows of a history joined with what its run declares: ended ranks whose number or size of flushes is another."""
    ended, most = F.col("complete"), F.when(F.col(every) > 0, F.least(F.col(every), F.col("rows"))).otherwise(F.col("rows"))
    return {
        "number of flushes": ended & (F.col("flushes") != expected_flushes(F.col("rows"), F.col(every))),
        "size of flushes": ended & (F.col("peak_buffered_rows") != most),
        "rows refused": F.col("refused") > 0,
    }
