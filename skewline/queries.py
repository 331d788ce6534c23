"""The engine's queries over the driver tables, each with the SQL that says the same.

Projections: `lineitem` rows are rank metrics (order = step, line = rank), `events` are spans of ranks, `documents` are a
corpus, `part` is a string dictionary. Faults for guards are put in by rules on keys, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import rms_norm, uniform_draw
from .guards import violation_counts, violations
from .operators import calibration, checkpoints, compare, corpus, fleet, intervals, journals, lineage, metrics, profiler, traces
from .plans import campaign, planning
from .sources import generators, rank_journal, scratch, sealed_corpus, sinks

RANKS = 7
#: The two ranks of the declared fleet (fixed values).
MODELS = (
    {"rank": 0, "quadratic": 1.0, "linear": 8.0, "overhead": 20.0, "max_samples": 5, "max_padded_tokens": 600, "max_attention_cells": 60000},
    {"rank": 1, "quadratic": 2.0, "linear": 8.0, "overhead": 20.0, "max_samples": 5, "max_padded_tokens": 400, "max_attention_cells": 40000},
)
PLAN_SEED, WORLD, BATCH = 17, 2, 3
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("run"), (F.col("l_orderkey") % 6).cast("string")).alias("run"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").cast("long").alias("rank"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus")


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (step, rank), the first by part, supplier, quantity and price; found by an aggregation, not a sort."""
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("m")
    rows = raw_metrics(spark, sf_dir).groupBy("run", "step", "rank").agg(first).select("run", "step", "rank", "m.*")
    tokens = F.col("l_quantity").cast("long")
    return rows.select(
        "run",
        "step",
        "rank",
        (F.col("step") % 10 == 0).alias("warmup"),
        tokens.alias("local_tokens"),
        F.sum(tokens).over(Window.partitionBy("run", "step")).alias("global_tokens"),
        (tokens + F.col("l_partkey") % 7).alias("padded_tokens"),
        (F.col("l_extendedprice") / 1000).alias("step_ms"),
        (F.col("l_quantity") * 2).alias("loss_sum"),
        (F.col("l_extendedprice") / 100).alias("predicted_cost"),
        F.col("l_suppkey").alias("peak_memory_bytes"),
    )


SQL_METRICS = """
raw AS (SELECT 'run' || (l_orderkey % 6) AS run, l_orderkey AS step, CAST(l_linenumber AS BIGINT) AS rank, * FROM lineitem),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM raw) WHERE k = 1),
m AS (SELECT run, step, rank, step % 10 = 0 AS warmup, CAST(l_quantity AS BIGINT) AS local_tokens,
  CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY run, step) AS BIGINT) AS global_tokens,
  CAST(l_quantity AS BIGINT) + l_partkey % 7 AS padded_tokens, l_extendedprice / 1000 AS step_ms, l_quantity * 2 AS loss_sum,
  l_extendedprice / 100 AS predicted_cost, l_suppkey AS peak_memory_bytes FROM one)"""


def faulty_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics with faults by rule: odd times, negative or unpadded tokens, ranks that disagree."""
    rows = rank_metrics(spark, sf_dir)
    key = F.col("step") * 7 + F.col("rank")
    return rows.withColumns(
        {
            "step_ms": F.when(key % 97 == 0, F.lit(float("nan"))).when(key % 89 == 0, -F.col("step_ms")).otherwise(F.col("step_ms")),
            "local_tokens": F.when(key % 101 == 0, -F.col("local_tokens")).otherwise(F.col("local_tokens")),
            "padded_tokens": F.when(key % 103 == 0, F.lit(-1000).cast("long")).otherwise(F.col("padded_tokens")),
            "predicted_cost": F.when(key % 107 == 0, F.lit(0.0)).otherwise(F.col("predicted_cost")),
            "global_tokens": F.when(key % 113 == 0, F.col("global_tokens") + 1).otherwise(F.col("global_tokens")),
        }
    )


SQL_FAULTY = SQL_METRICS + """,
f AS (SELECT run, step, rank, warmup, loss_sum, peak_memory_bytes,
  CASE WHEN k % 97 = 0 THEN 'nan'::DOUBLE WHEN k % 89 = 0 THEN -step_ms ELSE step_ms END AS step_ms,
  CASE WHEN k % 101 = 0 THEN -local_tokens ELSE local_tokens END AS local_tokens,
  CASE WHEN k % 103 = 0 THEN -1000 ELSE padded_tokens END AS padded_tokens,
  CASE WHEN k % 107 = 0 THEN 0 ELSE predicted_cost END AS predicted_cost,
  CASE WHEN k % 113 = 0 THEN global_tokens + 1 ELSE global_tokens END AS global_tokens
  FROM (SELECT *, step * 7 + rank AS k FROM m))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, step, kind, s, e) in microseconds; sign-ups are step windows."""
    kind = F.when(F.col("event_type") == "click", "compute").when(F.col("event_type") == "purchase", "collective").when(F.col("event_type") == "view", "transfer").when(F.col("event_type") == "signup", "window").otherwise("host")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rank"), F.col("event_id").alias("step"), kind.alias("kind"), start.alias("s"), (start + F.floor(F.col("value") * 1000 + 0.5) * 1000000).alias("e"))


SQL_SPANS = """
spans AS (SELECT user_id AS rank, event_id AS step,
  CASE event_type WHEN 'click' THEN 'compute' WHEN 'purchase' THEN 'collective' WHEN 'view' THEN 'transfer' WHEN 'signup' THEN 'window' ELSE 'host' END AS kind,
  epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 1000 + 0.5) AS BIGINT) * 1000000 AS e FROM events)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (2 + n % 127).cast("long").alias("length"))


SQL_SAMPLES = "samples AS (SELECT doc_id AS id, CAST(2 + octet_length(encode(coalesce(text, ''))) % 127 AS BIGINT) AS length FROM documents)"
SQL_PLAN = SQL_SAMPLES + f""",
placed AS (SELECT *, row_number() OVER (ORDER BY md5('{PLAN_SEED}:' || id), id) - 1 AS p, count(*) OVER () AS n FROM samples),
plan AS (SELECT id, length, p // {WORLD * BATCH} AS step, (p % {WORLD * BATCH}) // {BATCH} AS rank, p % {BATCH} AS pos FROM placed WHERE p < n - n % {WORLD * BATCH})"""
SQL_MODELS = "models AS (SELECT * FROM (VALUES " + ", ".join(f"({m['rank']}, {m['quadratic']}::DOUBLE, {m['linear']}::DOUBLE, {m['overhead']}::DOUBLE, {m['max_samples']}, {m['max_padded_tokens']}, {m['max_attention_cells']})" for m in MODELS) + ") t(rank, q, l, o, ms, mt, mc))"
SQL_SHAPES = f"WITH {SQL_PLAN}, {SQL_MODELS}, " + """
shapes AS (SELECT step, rank, count(*) AS n, max(length - 1) AS w, sum(length - 1)::BIGINT AS tokens FROM plan GROUP BY ALL),
costs AS (SELECT step, s.rank, n, w, tokens, q * n * w * w + l * n * w + o AS cost, n <= ms AND n * w <= mt AND n * w * w <= mc AS ok FROM shapes s JOIN models m ON s.rank = m.rank),
alone AS (SELECT step, p.id, min(q * (length - 1) * (length - 1) + l * (length - 1) + o) AS a, min(q * (length - 1) * (length - 1) + l * (length - 1)) AS b
  FROM plan p LEFT JOIN models m ON 1 <= ms AND length - 1 <= mt AND (length - 1) * (length - 1) <= mc GROUP BY ALL),
bounds AS (SELECT step, CASE WHEN count(*) > count(a) THEN 'inf'::DOUBLE ELSE greatest(max(a), (sum(b) + (SELECT sum(o) FROM models)) / (SELECT count(*) FROM models)) END AS bound FROM alone GROUP BY step)"""


def models(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({m['rank']}L, {m['quadratic']}D, {m['linear']}D, {m['overhead']}D, {m['max_samples']}L, {m['max_padded_tokens']}L, {m['max_attention_cells']}L)" for m in MODELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rank, quadratic, linear, overhead, max_samples, max_padded_tokens, max_attention_cells)")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.deal(samples(spark, sf_dir), WORLD, BATCH, PLAN_SEED)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col(c) % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("rank"), at("l_partkey", (1, 2, 4, 8)).alias("batch"), at("l_suppkey", (4, 8, 16, 32)).alias("width"), "l_discount")
    b, w = F.col("batch"), F.col("width")
    return rows.select("rank", "batch", "width", (0.003 * b * w * w + 0.02 * b * w + 0.7 + F.col("l_discount")).alias("ms"))


SQL_OBSERVATIONS = """
o AS (SELECT CAST(l_linenumber % 4 AS BIGINT) AS rank, CAST([1,2,4,8][l_partkey % 4 + 1] AS BIGINT) AS batch, CAST([4,8,16,32][l_suppkey % 4 + 1] AS BIGINT) AS width, l_discount FROM lineitem),
obs AS (SELECT rank, batch, width, 0.003::DOUBLE * batch * width * width + 0.02::DOUBLE * batch * width + 0.7::DOUBLE + l_discount AS ms FROM o),
med AS (SELECT rank, batch, width, median(ms) AS ms FROM obs GROUP BY ALL)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_metrics(spark, sf_dir).select((F.col("l_suppkey") % 16).alias("seed"), F.col("l_linestatus").alias("arm"), (F.col("l_extendedprice") / 1000).alias("step_ms"))
    return compare.paired_speedups(rows, "F", "O")


SQL_PAIRS = """
arms AS (SELECT l_suppkey % 16 AS seed, median(CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 1000 END) AS a, median(CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 1000 END) AS b FROM lineitem GROUP BY 1),
pairs AS (SELECT seed, a AS baseline_ms, b AS candidate_ms, a / b AS speedup FROM arms WHERE a IS NOT NULL AND b IS NOT NULL)"""


def rounded(df: DataFrame, places: int = 6, **names: str) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, places).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {SQL_METRICS} SELECT run, step, count(DISTINCT rank) AS observed_ranks, round(max(step_ms), 6) AS step_ms, round(min(step_ms), 6) AS fastest_rank_ms,
 sum(local_tokens)::BIGINT AS tokens, min(global_tokens) AS min_global_tokens, max(global_tokens) AS max_global_tokens, sum(padded_tokens)::BIGINT AS padded_tokens, round(sum(loss_sum), 6) AS loss_sum, max(peak_memory_bytes) AS peak_memory_bytes,
 round(sum(local_tokens) / max(step_ms) * 1000, 6) AS tokens_per_second, round(1 - sum(local_tokens) / sum(padded_tokens), 6) AS padding_fraction, round(sum(loss_sum) / sum(local_tokens), 6) AS loss
 FROM m WHERE NOT warmup GROUP BY run, step""")
def step_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.step_aggregates(rank_metrics(spark, sf_dir)))


@query("SELECT 'run' || (l_orderkey % 6) AS run, l_orderkey AS step, l_linenumber::BIGINT AS rank, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicates(raw_metrics(spark, sf_dir))


@query(f"""WITH {SQL_FAULTY}, s AS (SELECT run, step, sum(local_tokens)::BIGINT AS tokens, max(global_tokens) AS hi, min(global_tokens) AS lo, max(step_ms) AS ms FROM f WHERE NOT warmup GROUP BY run, step)
SELECT run, step, unnest(list_filter([CASE WHEN tokens <> hi THEN 'tokens differ from the global batch' END, CASE WHEN lo <> hi THEN 'ranks disagree on the global batch' END, CASE WHEN isnan(ms) OR ms <= 0 THEN 'step time' END], lambda x: x IS NOT NULL)) AS rule FROM s""")
def coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faulty_metrics(spark, sf_dir).filter(~F.col("warmup"))
    return violations(metrics.step_totals(rows), metrics.coverage_rules()).select("run", "step", "rule")


@query(f"""WITH {SQL_FAULTY} SELECT rule, n FROM (SELECT 'null field' AS rule, 0 AS n UNION ALL SELECT 'step_ms', count(*) FILTER (isnan(step_ms) OR step_ms <= 0) FROM f UNION ALL SELECT 'loss_sum', 0
 UNION ALL SELECT 'local_tokens', count(*) FILTER (local_tokens < 0) FROM f UNION ALL SELECT 'padded_tokens', count(*) FILTER (padded_tokens < local_tokens) FROM f UNION ALL SELECT 'predicted_cost', count(*) FILTER (predicted_cost <= 0) FROM f)""")
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faulty_metrics(spark, sf_dir)
    return violation_counts(rows, metrics.row_rules(rows))


@query(f"""WITH {SQL_METRICS}, grid AS (SELECT run, step, rank FROM (SELECT DISTINCT run, step FROM m), (SELECT unnest(range(1, {RANKS + 1}))::BIGINT AS rank))
SELECT g.run, g.rank, count(*) AS missing_steps FROM grid g ANTI JOIN m ON g.run = m.run AND g.step = m.step AND g.rank = m.rank GROUP BY ALL""")
def missing_rank_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = metrics.missing_rank_steps(rank_metrics(spark, sf_dir), spark.range(1, RANKS + 1).toDF("rank"))
    return gone.groupBy("run", "rank").agg(F.count(F.lit(1)).alias("missing_steps"))


SQL_STEPS = f"""WITH {SQL_METRICS}, steps AS (SELECT run, step, max(step_ms) AS step_ms, sum(local_tokens)::BIGINT AS tokens, sum(padded_tokens) AS padded, sum(loss_sum) AS loss_sum, max(step_ms) - min(step_ms) AS spread, max(predicted_cost) / avg(predicted_cost) AS imbalance FROM m WHERE NOT warmup GROUP BY run, step)"""


@query(SQL_STEPS + " SELECT run, step, round(step_ms, 6) AS step_ms, tokens, round(loss_sum / tokens, 6) AS loss, round(spread, 6) AS rank_spread_ms, round(imbalance, 6) AS proxy_imbalance, round(1 - tokens / padded, 6) AS padding_fraction FROM steps")
def step_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.step_items(rank_metrics(spark, sf_dir)))


@query(SQL_STEPS + """, memory AS (SELECT run, max(peak_memory_bytes) AS mem FROM m GROUP BY run)
SELECT s.run, count(*) AS measured_steps, round(sum(tokens) / sum(step_ms) * 1000, 6) AS tokens_per_second, round(avg(1 - tokens / padded), 6) AS mean_padding_fraction, max(mem) AS max_peak_memory_bytes FROM steps s JOIN memory USING (run) GROUP BY s.run""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_totals(rank_metrics(spark, sf_dir)))


@query(SQL_STEPS + " SELECT run, round(quantile_cont(step_ms, 0.5), 6) AS p50, round(quantile_cont(step_ms, 0.95), 6) AS p95 FROM steps GROUP BY run")
def run_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_quantiles(metrics.step_items(rank_metrics(spark, sf_dir))))


@query(SQL_STEPS + " SELECT run, round(quantile_cont(step_ms, 0.95), 6) AS value FROM steps GROUP BY run")
def run_quantiles_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_quantiles_sorted(metrics.step_items(rank_metrics(spark, sf_dir)), 0.95))


@query(SQL_STEPS + ", q AS (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q) SELECT run, q, round(CASE q WHEN 0.05 THEN quantile_cont(step_ms, 0.05) WHEN 0.5 THEN quantile_cont(step_ms, 0.5) ELSE quantile_cont(step_ms, 0.95) END, 6) AS value FROM steps, q GROUP BY run, q")
def run_quantiles_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_quantiles_selected(metrics.step_items(rank_metrics(spark, sf_dir)), (0.05, 0.5, 0.95)))


def journal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics as runs of at most 2,048 orders whose ranks count their steps from 0 without gaps."""
    rows = rank_metrics(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), F.expr("step div 2048")))
    return rows.withColumn("step", (F.row_number().over(Window.partitionBy("run", "rank").orderBy("step")) - 1).cast("long"))


SQL_JOURNALS = SQL_METRICS + """,
j AS (SELECT 'run' || (step // 2048) AS run, rank, row_number() OVER (PARTITION BY step // 2048, rank ORDER BY step) - 1 AS step, warmup, local_tokens, global_tokens, padded_tokens, step_ms, loss_sum FROM m)"""


def written_journals(spark: SparkSession, sf_dir: str) -> str:
    """The folder of journals of all runs, written in two batches by the journal sink."""
    path, rows = scratch.new_folder(spark, "journals"), scratch.stored(journal_metrics(spark, sf_dir))
    rank_journal.write_rows(rows.filter("step < 100"), path)
    rank_journal.write_rows(rows.filter("step >= 100"), path)
    return path.removeprefix("file:")


RUN_NAME = "regexp_extract(run, '([^/]*)$', 1)"


@query(f"WITH {SQL_JOURNALS} SELECT run, rank, step, warmup, local_tokens, global_tokens, padded_tokens, step_ms, loss_sum FROM j")
def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to journals and read back from their committed prefixes."""
    rows = rank_journal.committed_rows(spark, f"{written_journals(spark, sf_dir)}/*")
    return rows.select(F.expr(RUN_NAME).alias("run"), "rank", "step", "warmup", "local_tokens", "global_tokens", "padded_tokens", "step_ms", "loss_sum")


@query(f"WITH {SQL_JOURNALS}, k AS (SELECT run, rank, max(step) AS last FROM j GROUP BY ALL) SELECT run, 7::BIGINT AS world_size, count(*) AS ranks, CASE WHEN count(*) = 7 THEN min(last) END AS durable_through_step, 'partial' AS status FROM k GROUP BY run")
def journal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each run is durable, told by its journals."""
    told = rank_journal.journal_status(spark, f"{written_journals(spark, sf_dir)}/*").withColumn("run", F.expr(RUN_NAME))
    return journals.run_status(told, told.select("run", F.lit(RANKS).cast("long").alias("world_size")).distinct())


@query(f"WITH {SQL_JOURNALS} SELECT run, step, count(*) AS rank_rows, round(max(step_ms), 6) AS step_ms, sum(local_tokens)::BIGINT AS tokens, sum(padded_tokens)::BIGINT AS padded_tokens FROM j WHERE NOT warmup GROUP BY run, step")
def journal_stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals read as a stream, and its running aggregates as they stand when all is read."""
    from .streaming.metrics import stream_step_aggregates as aggregate

    steps = aggregate(rank_journal.stream_rows(spark, f"{written_journals(spark, sf_dir)}/*"))
    out = scratch.new_folder(spark, "steps")
    write = steps.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    write.option("checkpointLocation", scratch.new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(out).select(F.expr(RUN_NAME).alias("run"), "step", "rank_rows", "step_ms", "tokens", "padded_tokens"))


SQL_FAULTY_RUNS = f"""WITH {SQL_JOURNALS}, n AS (SELECT run, max(step) + 1 AS steps, CAST(substr(run, 4) AS BIGINT) % 6 AS k FROM j GROUP BY run),
runs AS (SELECT run, k, CASE k WHEN 4 THEN steps - 1 ELSE steps END AS steps, CASE k WHEN 5 THEN steps ELSE 4 END AS warmup FROM n),
f AS (SELECT j.run, step, max(CASE WHEN k = 3 AND step = 7 THEN 0 ELSE global_tokens END) AS tokens FROM j JOIN runs USING (run) WHERE (k <> 0 OR step >= 2) AND (k <> 1 OR step < runs.steps - 4) AND (k <> 2 OR step <> 5) GROUP BY ALL),
b AS (SELECT run, min(step) AS lo, max(step) AS hi, count(*) AS n, count(*) FILTER (tokens <= 0) AS z FROM f GROUP BY run)"""


@query(SQL_FAULTY_RUNS + """ SELECT run, 'steps are missing' AS rule FROM b JOIN runs USING (run) WHERE lo > 0 OR hi < steps - 1 OR n < hi - lo + 1
UNION ALL SELECT run, 'unexpected steps' FROM b JOIN runs USING (run) WHERE hi > steps - 1 UNION ALL SELECT run, 'no tokens' FROM b WHERE z > 0 UNION ALL SELECT run, 'no measured steps' FROM b JOIN runs USING (run) WHERE hi < warmup""")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that lost their first steps, their last, one between, or the tokens of one; that go on too long; that are all warm-up."""
    rows = scratch.stored(journal_metrics(spark, sf_dir))
    k = F.substring("run", 4, 20).cast("long") % 6
    runs = scratch.stored(rows.groupBy("run").agg((F.max("step") + 1).alias("n")))
    runs = runs.select("run", F.lit(0).cast("long").alias("start_step"), F.when(k == 4, F.col("n") - 1).otherwise(F.col("n")).alias("steps"), F.when(k == 5, F.col("n")).otherwise(F.lit(4)).alias("warmup"))
    lost = ((k == 0) & (F.col("step") < 2)) | ((k == 1) & (F.col("step") >= F.col("steps") - 4)) | ((k == 2) & (F.col("step") == 5))
    left = rows.join(runs.select("run", "steps"), "run").filter(~lost)
    left = left.withColumn("global_tokens", F.when((k == 3) & (F.col("step") == 7), F.lit(0).cast("long")).otherwise(F.col("global_tokens")))
    return metrics.completeness_violations(left, runs)


@query(SQL_STEPS + " SELECT run, sha256(string_agg(step || ':' || tokens || chr(10), '' ORDER BY step)) AS workload_sha256 FROM steps GROUP BY run")
def workload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.workload_hashes(metrics.step_items(rank_metrics(spark, sf_dir)))


@query(f"WITH {SQL_METRICS} SELECT run, rank, count(*) AS rows, round(max(step_ms), 6) AS max_step_ms, max(peak_memory_bytes) AS max_memory FROM m GROUP BY run, rank")
def rank_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rank_maxima(rank_metrics(spark, sf_dir)))


@query(f"WITH {SQL_PAIRS} SELECT seed, round(baseline_ms, 6) AS baseline_ms, round(candidate_ms, 6) AS candidate_ms, round(speedup, 6) AS speedup FROM pairs")
def paired_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir))


@query(f"WITH {SQL_PAIRS} SELECT count(*) AS pairs, round(exp(avg(ln(speedup))), 6) AS geometric_mean_speedup FROM pairs")
def geomean_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.geometric_mean(paired(spark, sf_dir)))


@query(f"""WITH {SQL_PAIRS}, logs AS (SELECT list(ln(speedup) ORDER BY seed) AS v, count(*) AS n, exp(avg(ln(speedup))) AS g FROM pairs),
draws AS (SELECT r, v[1 + CAST(floor(('0x' || substr(md5('19:' || r || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n) AS BIGINT)] AS x, n, g FROM logs, (SELECT unnest(range(0, 4000)) AS r), (SELECT unnest(range(0, 1000)) AS i) WHERE i < n),
reps AS (SELECT r, n, g, exp(avg(x)) AS value FROM draws GROUP BY ALL), ci AS (SELECT n AS pairs, g, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM reps GROUP BY ALL)
SELECT pairs, round(g, 6) AS geometric_mean_speedup, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 1 THEN 'candidate faster in sampled runs' WHEN hi < 1 THEN 'candidate slower in sampled runs' ELSE 'interval includes no improvement' END AS verdict FROM ci""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.bootstrap_interval(paired(spark, sf_dir)))


@query(f"""WITH {SQL_SPANS}, a AS (SELECT rank, kind, s, e, max(e) OVER (PARTITION BY rank, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans WHERE e > s AND kind <> 'window'),
b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY rank, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a)
SELECT rank, kind, min(s) AS s, max(e) AS e FROM b GROUP BY rank, kind, i""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(spans(spark, sf_dir).filter("kind <> 'window'").select("rank", "kind", "s", "e"), ["rank", "kind"])


@query(f"""WITH {SQL_SPANS} SELECT a.rank, a.kind, w.step, greatest(a.s, w.s) AS s, least(a.e, w.e) AS e FROM spans a JOIN spans w ON a.rank = w.rank AND w.kind = 'window' AND a.s < w.e AND a.e > w.s WHERE a.kind <> 'window'""")
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    windows = rows.filter("kind = 'window'").select("rank", "step", "s", "e")
    return intervals.bucketed_clip_join(rows.filter("kind <> 'window'").drop("step"), windows, ["rank"], ["step"], 3.6e9).select("rank", "kind", "step", "s", "e")


@query(f"""WITH {SQL_SPANS}, w AS (SELECT rank, step, s, e FROM spans WHERE kind = 'window'),
c AS (SELECT a.rank, w.step, a.kind, greatest(a.s, w.s) AS s, least(a.e, w.e) AS e FROM spans a JOIN w ON a.rank = w.rank AND a.s < w.e AND a.e > w.s WHERE a.kind <> 'window'),
p AS (SELECT DISTINCT rank, step, s AS t FROM c UNION SELECT DISTINCT rank, step, e FROM c), q AS (SELECT rank, step, t, lead(t) OVER (PARTITION BY rank, step ORDER BY t) AS u FROM p),
o AS (SELECT q.rank, q.step, u - t AS d, coalesce(bool_or(kind = 'compute'), false) AS x, coalesce(bool_or(kind = 'collective'), false) AS n, coalesce(bool_or(kind = 'transfer'), false) AS h FROM q LEFT JOIN c ON c.rank = q.rank AND c.step = q.step AND c.s <= t AND c.e >= u WHERE u IS NOT NULL GROUP BY q.rank, q.step, t, u),
z AS (SELECT rank, step, sum(d) FILTER (x) AS compute, sum(d) FILTER (n) AS collective, sum(d) FILTER (h) AS transfer, sum(d) FILTER (x AND n) AS overlap, sum(d) FILTER (n AND NOT x) AS exposed, sum(d) FILTER (x OR n OR h) AS busy FROM o GROUP BY rank, step)
SELECT w.rank, w.step, (e - s)::DOUBLE AS "window", coalesce(compute, 0)::DOUBLE AS compute, coalesce(collective, 0)::DOUBLE AS collective, coalesce(transfer, 0)::DOUBLE AS transfer, coalesce(overlap, 0)::DOUBLE AS overlap, coalesce(exposed, 0)::DOUBLE AS exposed, coalesce(busy, 0)::DOUBLE AS busy, greatest(0, e - s - coalesce(busy, 0))::DOUBLE AS uncovered FROM w LEFT JOIN z USING (rank, step)""")
def exposed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).withColumns({"s": F.col("s").cast("double"), "e": F.col("e").cast("double")})
    windows = rows.filter("kind = 'window'").select("rank", "step", "s", "e")
    return intervals.window_measures(rows.filter("kind <> 'window'").drop("step"), windows, ["rank"], "step")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as events of an execution trace, a rank's in each: kernels, copies, annotations of steps, and host work."""
    kind = F.col("kind")
    name = F.when(kind == "window", F.concat(F.lit("train/step/"), F.col("step").cast("string"))).when(kind == "collective", "ncclDevKernel_AllReduce").when(kind == "host", "nccl host call").otherwise("gemm")
    cat = F.when(kind == "window", "user_annotation").when(kind == "transfer", "gpu_memcpy").when(kind == "host", "cpu_op").otherwise("Kernel")
    return spans(spark, sf_dir).select("rank", F.lit("X").alias("ph"), name.alias("name"), cat.alias("cat"), F.col("s").cast("double").alias("ts"), (F.col("e") - F.col("s")).cast("double").alias("dur"))


@query(f"WITH {SQL_SPANS} SELECT rank, kind, count(*) AS n, sum(e - s)::BIGINT AS length FROM spans WHERE kind IN ('compute', 'collective', 'transfer') GROUP BY ALL")
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = traces.classify(traces.complete_events(trace_events(spark, sf_dir)))
    return work.groupBy("rank", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dur").cast("long")).alias("length"))


@query(f"WITH {SQL_SPANS} SELECT rank, step, s, e FROM spans WHERE kind = 'window'")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.step_windows(traces.complete_events(trace_events(spark, sf_dir)), keys=("rank",))
    return rows.withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")})


SQL_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents), k AS (SELECT *, CASE WHEN n < 128 THEN 0 ELSE (n - 1) // 127 END AS f FROM d), a AS (SELECT doc_id AS doc, t, n, f, n - f * 127 AS tail FROM k)"


@query(f"WITH {SQL_DOCS}, w AS (SELECT doc, n, unnest(range(0, f + CASE WHEN tail >= 2 THEN 1 ELSE 0 END)) AS piece FROM a) SELECT doc, piece, least(128, n - piece * 127) AS length FROM w")
def corpus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.windows(contents(spark, sf_dir)).select("doc", "piece", "length")


@query(f"WITH {SQL_DOCS} SELECT doc, n AS bytes, f + CASE WHEN tail >= 2 THEN 1 ELSE 0 END AS samples, f * 127 + CASE WHEN tail >= 2 THEN tail - 1 ELSE 0 END AS valid_tokens, CASE WHEN tail >= 2 THEN 0 ELSE greatest(0, tail - 1) END AS dropped_targets, sha256(t) AS sha256 FROM a")
def corpus_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.accounting(contents(spark, sf_dir))


@query(f"WITH {SQL_DOCS} SELECT count(*) AS documents, sum(n)::BIGINT AS bytes, sum(f + CASE WHEN tail >= 2 THEN 1 ELSE 0 END)::BIGINT AS samples, sum(f * 127 + CASE WHEN tail >= 2 THEN tail - 1 ELSE 0 END)::BIGINT AS valid_tokens, sum(CASE WHEN tail >= 2 THEN 0 ELSE greatest(0, tail - 1) END)::BIGINT AS dropped_targets FROM a")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.totals(corpus.accounting(contents(spark, sf_dir)))


@query(f"WITH {SQL_DOCS} SELECT doc, n AS length, (sum(n) OVER (ORDER BY doc) - n)::BIGINT AS \"offset\" FROM a")
def corpus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = contents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.octet_length("content").cast("long").alias("length"))
    return corpus.offsets(sizes)


@query("""WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents), o AS (SELECT doc_id AS sample_id, n AS length, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS x FROM s)
SELECT sample_id, 'offset' AS rule FROM o WHERE sample_id % 50 = 7 UNION ALL SELECT sample_id, 'length' FROM o WHERE length < 2 OR length > 20000""")
def corpus_index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = contents(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), F.lit(0).cast("long").alias("doc"), F.octet_length("content").cast("long").alias("length"))
    stored = corpus.offsets(sizes, "sample_id").withColumn("offset", F.col("offset") + F.when(F.col("sample_id") % 50 == 7, 1).otherwise(0))
    return corpus.verify_index(stored, 2, 20000).select("sample_id", "rule")


@query("""WITH h AS (SELECT doc_id // 1000 AS part, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')) || chr(10), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY part)) AS corpus_sha256 FROM h""")
def corpus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.identity(corpus.accounting(contents(spark, sf_dir)))


@query(f"WITH {SQL_PLAN} SELECT step, rank, pos, id, length FROM plan")
def random_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir).select("step", "rank", "pos", "id", "length")


@query(SQL_SHAPES + " SELECT step, rank, n AS count, w AS width, tokens, n * w * w AS padded_cost, cost FROM costs")
def plan_shape_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.with_models(planning.group_shapes(dealt(spark, sf_dir)), models(spark)).select("step", "rank", "count", "width", "tokens", "padded_cost", "cost")


@query(SQL_SHAPES + " SELECT step, max(cost) AS makespan, sum(cost) AS total, count(*) AS ranks, bool_and(ok) AS feasible FROM costs GROUP BY step")
def plan_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.objective(planning.with_models(planning.group_shapes(dealt(spark, sf_dir)), models(spark)))


@query(SQL_SHAPES + " SELECT step, rank, n AS count, w AS width FROM costs WHERE NOT ok")
def capacity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.with_models(planning.group_shapes(dealt(spark, sf_dir)), models(spark)).filter("NOT permitted").select("step", "rank", "count", "width")


@query(SQL_SHAPES + " SELECT step, bound AS lower_bound FROM bounds")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.lower_bounds(dealt(spark, sf_dir), models(spark))


@query(SQL_SHAPES + """ SELECT c.step, sum(n)::BIGINT AS sample_count, sum(tokens)::BIGINT AS global_tokens, max(cost) AS makespan, sum(cost) AS total, bool_and(ok) AND count(*) = 2 AS feasible, any_value(bound) AS lower_bound, round(max(cost) / any_value(bound) - 1, 6) AS bound_gap FROM costs c JOIN bounds USING (step) GROUP BY c.step""")
def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.certificates(dealt(spark, sf_dir), models(spark)).withColumn("bound_gap", F.round("bound_gap", 6))


@query(f"WITH {SQL_PLAN} SELECT step, id, 1 AS n FROM plan WHERE id % 97 = 3")
def assignment_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = dealt(spark, sf_dir)
    return planning.lost_samples(plan, plan.filter("id % 97 <> 3")).withColumn("n", F.col("n").cast("int"))


@query(f"""WITH {SQL_PLAN}, t AS (SELECT step, count(*) AS samples, sum(length - 1)::BIGINT AS tokens FROM plan GROUP BY step) SELECT step, samples, tokens, true AS no_worse FROM t""")
def balanced_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step keeps its samples and tokens, and no step's slowest rank is slower by proxy than as dealt."""
    plan = dealt(spark, sf_dir)
    worst = lambda p: planning.group_shapes(p).groupBy("step").agg(F.sum("count").alias("samples"), F.sum("tokens").alias("tokens"), F.max("padded_cost").alias("worst"))
    after, before = worst(planning.balanced_plan(plan, WORLD, BATCH)), worst(plan).select("step", F.col("worst").alias("before"))
    return after.join(before, "step").select("step", "samples", "tokens", (F.col("worst") <= F.col("before")).alias("no_worse"))


@query(None)
def fleet_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planning.fleet_plan(dealt(spark, sf_dir), list(MODELS))
    return planning.certificates(plan, models(spark))


SQL_EXACT = SQL_SHAPES + f""", ordered AS (SELECT step, length - 1 AS w, row_number() OVER (PARTITION BY step ORDER BY id) - 1 AS k FROM plan),
layouts AS (SELECT step, a, (a >> k) & 1 AS rank, count(*) AS n, max(w) AS w FROM ordered, (SELECT unnest(range(0, {1 << (WORLD * BATCH)})) AS a) GROUP BY ALL),
valued AS (SELECT step, a, count(*) AS ranks, bool_and(n <= ms AND n * w <= mt AND n * w * w <= mc) AS ok, max(q * n * w * w + l * n * w + o) AS makespan FROM layouts l1 JOIN models m ON l1.rank = m.rank GROUP BY step, a),
best AS (SELECT step, min(makespan) FILTER (ok AND ranks = 2) AS makespan FROM valued GROUP BY step)
SELECT step, CASE WHEN makespan IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, makespan FROM best"""


@query(SQL_EXACT)
def oracle_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.exact_plan(dealt(spark, sf_dir), list(MODELS)).select("step", "status", "makespan")


@query(None)
def campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.summarize(campaign.run_campaign(spark))


@query(f"WITH {SQL_OBSERVATIONS} SELECT rank, batch, width, round(ms, 6) AS ms FROM med")
def calibration_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.medians(observations(spark, sf_dir)))


SQL_GRAM = f"""WITH {SQL_OBSERVATIONS}, x AS (SELECT rank, ms, (batch * width * width)::DOUBLE AS x0, (batch * width)::DOUBLE AS x1 FROM med), s AS (SELECT rank, max(x0) AS s0, max(x1) AS s1 FROM x GROUP BY rank),
z AS (SELECT x.rank, ms, x0 / s0 AS a, x1 / s1 AS b, s0, s1 FROM x JOIN s ON x.rank = s.rank)"""


@query(SQL_GRAM + " SELECT rank, count(*) AS n, any_value(s0) AS s0, any_value(s1) AS s1, 1.0::DOUBLE AS s2, round(sum(a * a), 6) AS g00, round(sum(a * b), 6) AS g01, round(sum(a), 6) AS g02, round(sum(b * b), 6) AS g11, round(sum(b), 6) AS g12, count(*)::DOUBLE AS g22, round(sum(a * ms), 6) AS r0, round(sum(b * ms), 6) AS r1, round(sum(ms), 6) AS r2, round(sum(ms * ms), 6) AS yy FROM z GROUP BY rank")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.gram(calibration.medians(observations(spark, sf_dir))))


@query(SQL_GRAM + """, m AS (SELECT rank, avg(a) AS ma, avg(b) AS mb, avg(ms) AS my FROM z GROUP BY rank),
c AS (SELECT z.rank, any_value(s0) AS s0, any_value(s1) AS s1, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (ms - my)) AS ay, sum((b - mb) * (ms - my)) AS by_ FROM z JOIN m ON z.rank = m.rank GROUP BY z.rank),
k AS (SELECT *, (ay * bb - ab * by_) / (aa * bb - ab * ab) AS ka, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS kb FROM c)
SELECT rank, round(ka / s0, 6) AS quadratic, round(kb / s1, 6) AS linear, round(my - ka * ma - kb * mb, 6) AS overhead FROM k""")
def nnls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.nonnegative_fit(calibration.medians(observations(spark, sf_dir))).drop("squared_error"))


@query(f"""WITH {SQL_OBSERVATIONS}, p AS (SELECT rank, ms, 0.003::DOUBLE * batch * width * width + 0.02::DOUBLE * batch * width + 0.7::DOUBLE AS y FROM med)
SELECT rank, count(*) AS shapes, round(median(abs(y / ms - 1)), 6) AS median_relative_error, round(max(abs(y / ms - 1)), 6) AS max_relative_error, round(sqrt(avg((y - ms) * (y - ms))), 6) AS rmse_ms FROM p GROUP BY rank""")
def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = calibration.medians(observations(spark, sf_dir))
    known = shapes.select("rank").distinct().select("rank", F.lit(0.003).alias("quadratic"), F.lit(0.02).alias("linear"), F.lit(0.7).alias("overhead"))
    return rounded(calibration.errors(shapes, known))


@query(f"WITH {SQL_OBSERVATIONS} SELECT rank, min(batch) AS min_batch, max(batch) AS max_batch, min(width) AS min_width, max(width) AS max_width FROM obs GROUP BY rank")
def calibration_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.domains(observations(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, coalesce(p.p_name, CAST(l_partkey AS VARCHAR)) AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) p ON l_partkey = p_partkey")
def dictionary_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return profiler.resolve(rows, strings, "l_partkey").drop("l_partkey")


SQL_MARKERS = f"""WITH {SQL_METRICS}, g AS (SELECT run, rank, max(step) AS last_step FROM m GROUP BY ALL), k AS (SELECT run, rank, CASE WHEN run = 'run3' AND rank = 7 THEN NULL ELSE last_step END AS last_step, run <> 'run4' OR rank <> 2 AS intact, run IN ('run1', 'run3', 'run4') AS complete FROM g)"""


@query(SQL_MARKERS + """ SELECT run, 7::BIGINT AS world_size, count(last_step) AS ranks, CASE WHEN count(last_step) = 7 THEN min(last_step) END AS durable_through_step, CASE WHEN bool_or(NOT intact) THEN 'invalid' WHEN count(last_step) = 7 AND bool_and(complete) THEN 'complete' ELSE 'partial' END AS status FROM k GROUP BY run""")
def durable_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_metrics(spark, sf_dir).groupBy("run", "rank").agg(F.max("step").alias("last_step"))
    torn = (F.col("run") == "run3") & (F.col("rank") == 7)
    markers = rows.select("run", "rank", F.when(~torn, F.col("last_step")).alias("last_step"), ((F.col("run") != "run4") | (F.col("rank") != 2)).alias("intact"), F.col("run").isin("run1", "run3", "run4").alias("complete"))
    worlds = markers.select("run", F.lit(RANKS).cast("long").alias("world_size")).distinct()
    return journals.frontiers(markers, worlds)


@query(f"""WITH {SQL_METRICS}, j AS (SELECT run, rank, step // 6 AS step, row_number() OVER (PARTITION BY run, rank ORDER BY step) - 1 AS position, min(step // 6) OVER (PARTITION BY run, rank) AS start_step FROM m) SELECT run, rank, position, step, start_step + position AS expected FROM j WHERE step <> start_step + position""")
def journal_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("run", "rank")
    rows = rank_metrics(spark, sf_dir).select("run", "rank", F.floor(F.col("step") / 6).alias("step"), (F.row_number().over(own.orderBy("step")) - 1).cast("long").alias("position"))
    rows = rows.withColumn("start_step", F.min("step").over(own))
    return journals.sequence_breaks(rows, ["run", "rank"]).select("run", "rank", "position", "step", "expected")


@query("""WITH v AS (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, x, 1 / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-6::DOUBLE) AS s FROM v)
SELECT vec_id, round(list_sum(list_transform(x, lambda u: u * s)), 6) AS total, round(x[1] * s, 6) AS first, round(list_max(x) * s, 6) AS largest FROM n""")
def rmsnorm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    residual = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("residual"))
    out = rows.join(residual, "vec_id").select("vec_id", rms_norm("embedding", "residual").alias("y"))
    return rounded(out.select("vec_id", F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("y", F.lit(0)).alias("first"), F.array_max("y").alias("largest")))


@query("""WITH a AS (SELECT vec_id, label, embedding, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), x AS (SELECT vec_id, label, i, embedding[i + 1]::DOUBLE AS v FROM a)
SELECT CAST(label AS VARCHAR) AS path, count(*) AS elements, count(*) FILTER (vec_id % 10 = 0 AND i = 63) AS missing, round(max(CASE WHEN vec_id % 10 = 0 AND i = 63 THEN NULL WHEN vec_id % 7 = 0 THEN 0.5 ELSE 0 END), 6) AS max_error,
 bool_and(vec_id % 7 <> 0 AND NOT (vec_id % 10 = 0 AND i = 63)) AS equal FROM x GROUP BY label""")
def state_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("path"), F.posexplode("embedding").alias("i", "v"))
    a = rows.select("path", (F.col("vec_id") * 1000 + F.col("i")).alias("index"), F.col("v").cast("double").alias("value"))
    changed = rows.filter("NOT (vec_id % 10 = 0 AND i = 63)").withColumn("v", F.col("v").cast("double") + F.when(F.col("vec_id") % 7 == 0, 0.5).otherwise(0.0))
    return rounded(checkpoints.compare_states(a, changed.select("path", (F.col("vec_id") * 1000 + F.col("i")).alias("index"), F.col("v").alias("value"))))


SQL_CANDIDATES = "c AS (SELECT 'checkpoint-' || CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey END AS checkpoint, o_orderkey AS step, md5(CAST(o_orderkey AS VARCHAR)) AS sha256, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 2 END AS world FROM orders)"


@query(f"""WITH {SQL_CANDIDATES}, r AS (SELECT *, list_filter([CASE WHEN step < 1 THEN 'step' END, CASE WHEN checkpoint <> 'checkpoint-' || step THEN 'directory name' END, CASE WHEN world <> 2 THEN 'world size differs' END, CASE WHEN step >= 900 THEN 'no steps remain' END, CASE WHEN step % 41 <> 0 THEN CASE step % 13 WHEN 0 THEN 'storage size' WHEN 1 THEN 'storage missing' WHEN 2 THEN 'storage content' END END], lambda x: x IS NOT NULL) AS bad FROM c)
SELECT CASE WHEN len(bad) = 0 THEN 'eligible' ELSE 'rejected' END AS status, array_to_string(bad, ', ') AS reasons, count(*) AS n, max(step) AS last FROM r GROUP BY ALL""")
def checkpoint_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint_inspection(spark, sf_dir)
    return found.groupBy("status", F.array_join("reasons", ", ").alias("reasons")).agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last"))


def checkpoint_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(1).cast("long").alias("bytes"), F.lit("x").alias("sha256")) for p in (".metadata", "__0_0.distcp")])
    none = F.lit(None).cast("string")
    markers = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("checkpoint-"), F.when(key % 41 == 0, F.lit(0)).otherwise(key).cast("string")).alias("checkpoint"),
        F.lit(2).cast("long").alias("schema_version"),
        key.alias("step"),
        F.when(key % 5 == 0, 4).otherwise(2).cast("long").alias("world_size"),
        none.alias("torch_version"),
        none.alias("fleet_sha256"),
        none.alias("dataset_sha256"),
        F.md5(key.cast("string").cast("binary")).alias("sha256"),
        F.create_map(F.lit("width"), F.lit("64")).alias("config"),
        files.alias("files"),
    )
    there = markers.filter(key % 41 != 0).select("checkpoint", "step", F.explode("files").alias("f")).filter("NOT (step % 13 = 1 AND f.path LIKE '%distcp')")
    found = there.select("checkpoint", "f.path", F.when((F.col("step") % 13 == 0) & (F.col("f.path") == ".metadata"), 2).otherwise(F.col("f.bytes")).alias("bytes"), F.when(F.col("step") % 13 == 2, "y").otherwise(F.col("f.sha256")).alias("sha256"))
    mismatches = checkpoints.storage_mismatches(markers.filter(key % 41 != 0), found)
    return checkpoints.inspect(markers, mismatches, checkpoints.compatibility_rules(2, 900, {"width": "64"}))


@query(f"WITH {SQL_CANDIDATES} SELECT step, checkpoint, sha256 FROM c WHERE checkpoint = 'checkpoint-' || step AND world = 2 AND step % 13 > 2 AND step BETWEEN 1 AND 899 ORDER BY step DESC LIMIT 1")
def checkpoint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.select(checkpoint_inspection(spark, sf_dir))


@query("SELECT id, greatest(4, least(128, CAST(round_even(exp(ln(4::DOUBLE) + ('0x' || substr(md5('17:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (ln(128::DOUBLE) - ln(4::DOUBLE))), 0) AS BIGINT))) AS length FROM (SELECT unnest(range(0, 2000)) AS id)")
def generated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.log_uniform_lengths(spark, 2000, 4, 128)


@query("""WITH f AS (SELECT i % 2 AS rank, i // 2 AS step, 1 + ((17 * (i // 2) + 3 * (i % 2)) % 101) / 7.0::DOUBLE AS ms FROM (SELECT unnest(range(0, 20000)) AS i)), s AS (SELECT step, max(ms) AS ms FROM f GROUP BY step)
SELECT 'fixture' AS run, count(*) AS measured_steps, round(8 * count(*) / sum(ms) * 1000, 6) AS tokens_per_second, round(quantile_cont(ms, 0.5), 6) AS median_step_ms, round(quantile_cont(ms, 0.95), 6) AS p95_step_ms FROM s""")
def metric_fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_summary(generators.metric_fixture(spark, 10_000)).select("run", "measured_steps", "tokens_per_second", "median_step_ms", "p95_step_ms"))


@query(f"""WITH {SQL_SAMPLES} SELECT id, length, CAST(floor(('0x' || substr(md5('17:' || id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 256) AS INTEGER) AS first, 128 - (length - 1) AS padding FROM samples""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    made = rows.join(generators.batch_tokens(rows, 128, 256), "id")
    return made.select("id", "length", F.get("tokens", F.lit(0)).alias("first"), F.size(F.filter("targets", lambda t: t == -100)).cast("long").alias("padding"))


@query(f"WITH {SQL_METRICS} SELECT run, step, count(*) AS rank_rows, round(max(step_ms), 6) AS step_ms, sum(local_tokens)::BIGINT AS tokens, sum(padded_tokens)::BIGINT AS padded_tokens FROM m WHERE NOT warmup GROUP BY run, step")
def stream_step_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate's plan over the batch table: the same transformation serves both."""
    from .streaming.metrics import stream_step_aggregates as aggregate

    return rounded(aggregate(rank_metrics(spark, sf_dir)).select("run", "step", "rank_rows", "step_ms", "tokens", "padded_tokens"))


@query("SELECT doc_id, ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", uniform_draw(F.lit(5), F.col("doc_id")).alias("u"))


SQL_FLUSHES = f"""WITH {SQL_JOURNALS}, k AS (SELECT run, rank, count(*) AS n FROM j GROUP BY ALL), s AS (SELECT *, n = max(n) OVER (PARTITION BY run) AS ended FROM k)"""


@query(SQL_FLUSHES + """ SELECT run, rank, CASE WHEN ended THEN (n + 31) // 32 ELSE n // 32 END AS flushes, CASE WHEN ended THEN n ELSE n // 32 * 32 END AS rows, 0::BIGINT AS refused,
 least(n, 32) AS peak_buffered_rows, CASE WHEN ended THEN n ELSE n // 32 * 32 END - 1 AS last_step, ended AS complete FROM s WHERE ended OR n >= 32""")
def bounded_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals read as a stream and let go through buffers of 32 rows a rank; ranks that stop short of their run's end keep the rest."""
    from .streaming import flushing

    path = f"{written_journals(spark, sf_dir)}/*"
    told = scratch.stored(rank_journal.journal_status(spark, path))
    runs = told.groupBy("run").agg((F.max("last_step") + 1).alias("steps"))
    out, provider = scratch.new_folder(spark, "flushed"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE_STORE)
    try:
        write = flushing.bounded_flush(rank_journal.stream_rows(spark, path), runs, 32).writeStream.format("parquet").option("path", out)
        write.option("checkpointLocation", scratch.new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    history = flushing.flush_history(spark.read.parquet(out))
    return history.withColumn("run", F.expr(RUN_NAME))


def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs (run, parent, customer, start_step): each resumes the customer's order before it.

    Every fourth starts anew, some name a run that isn't there, and the orders of every tenth customer go round in a circle.
    """
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(own).alias("before"), F.max("o_orderkey").over(whole).alias("last"), (F.row_number().over(own) - 1).cast("long").alias("position"))
    key = F.col("o_orderkey")
    parent = F.when(F.col("o_custkey") % 10 == 7, F.coalesce("before", "last")).when(key % 4 == 0, F.lit(None)).when(key % 23 == 5, -key).otherwise(F.col("before"))
    return rows.select(key.alias("run"), parent.alias("parent"), F.col("o_custkey").alias("customer"), (F.col("position") * 2).alias("start_step"))


SQL_RUNS = """WITH o AS (SELECT o_custkey AS customer, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders),
b AS (SELECT *, customer % 10 = 7 AS circle, CASE WHEN p = 0 OR run % 4 = 0 OR run % 23 = 5 THEN 1 ELSE 0 END AS starts, run % 4 <> 0 AND run % 23 = 5 AS lost FROM o),
g AS (SELECT *, sum(starts) OVER (PARTITION BY customer ORDER BY p) AS part FROM b),
l AS (SELECT run, customer, p, circle, first_value(run) OVER w AS origin, first_value(p) OVER w AS p0, first_value(lost) OVER w AS lost, string_agg(run::VARCHAR, '>') OVER (PARTITION BY customer, part ORDER BY p ROWS UNBOUNDED PRECEDING) AS path FROM g WINDOW w AS (PARTITION BY customer, part ORDER BY p))"""


@query(SQL_RUNS + """ SELECT run, CASE WHEN NOT circle THEN origin END AS origin, CASE WHEN NOT circle THEN p - p0 END AS depth, CASE WHEN NOT circle THEN path END AS path, CASE WHEN circle THEN 'cycle' WHEN lost THEN 'parent missing' ELSE 'whole' END AS status FROM l""")
def recovery_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage(resumed_runs(spark, sf_dir).select("run", "parent")).withColumn("path", F.array_join("path", ">"))


@query(SQL_RUNS + """, h AS (SELECT r.run, s.run AS source, unnest(range(2 * s.p, 2 * s.p + CASE WHEN s.run = r.run THEN 4 ELSE 2 END)) AS step FROM l r JOIN l s ON r.customer = s.customer AND s.origin = r.origin AND s.p <= r.p WHERE NOT r.circle),
t AS (SELECT run, step, (source + step) % 17 = 0 AS gone, (source + step) % 11 = 0 AS other FROM h), e AS (SELECT run, min(step) AS lo, max(step) AS hi FROM t WHERE NOT gone GROUP BY run),
d AS (SELECT t.run, step, gone, other FROM t JOIN e ON t.run = e.run AND step BETWEEN lo AND hi)
SELECT run, count(*) AS steps, count(*) FILTER (gone) AS missing, count(*) FILTER (other AND NOT gone) AS differing, min(step) FILTER (gone OR other) AS first_step, coalesce(min_by(CASE WHEN gone THEN 'row' ELSE 'loss_sum' END, step) FILTER (gone OR other), '') AS paths, count(*) FILTER (gone OR other) = 0 AS equal FROM d GROUP BY run""")
def recovery_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the whole history of each resumed run first leaves what its customer's run would have been without a stop."""
    runs = scratch.stored(resumed_runs(spark, sf_dir))
    truth = (F.col("customer") * 1000 + F.col("step")).cast("double")
    rows = runs.select("run", "customer", F.explode(F.sequence(F.col("start_step"), F.col("start_step") + 3)).alias("step"))
    at = F.col("run") + F.col("step")
    rows = rows.filter(at % 17 != 0).select("run", F.lit(0).alias("rank"), "step", F.when(at % 11 == 0, truth + 1).otherwise(truth).alias("loss_sum"), F.lit(64).alias("local_tokens"))
    steps = runs.groupBy("customer").agg((F.max("start_step") + 3).alias("last"))
    references = steps.select("customer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("step")).select("customer", F.lit(0).alias("rank"), "step", truth.alias("loss_sum"), F.lit(64).alias("local_tokens"))
    pieces = lineage.stretches(lineage.lineage(runs.select("run", "parent")), runs.select("run", "start_step"))
    histories = lineage.stitched(rows, pieces).join(runs.select("run", "customer"), "run")
    found = lineage.first_differences(histories, references, ("local_tokens", "loss_sum"), "customer")
    return found.withColumn("paths", F.coalesce(F.array_join("paths", ","), F.lit("")))


@query(f"WITH {SQL_DOCS}, w AS (SELECT doc, n, unnest(range(0, f + CASE WHEN tail >= 2 THEN 1 ELSE 0 END)) AS piece FROM a) SELECT row_number() OVER (ORDER BY doc, piece) - 1 AS sample_id, doc, least(128, n - piece * 127) AS length FROM w")
def corpus_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written with its seals, opened with all of them checked, and read."""
    path = scratch.new_folder(spark, "corpus")
    sinks.write_corpus(contents(spark, sf_dir).withColumnRenamed("doc_id", "doc"), path)
    return sealed_corpus.SealedCorpus(spark, path).rows().select("sample_id", "doc", "length")


@query(f"""WITH {SQL_PLAN}, s AS (SELECT step, rank, count(*) AS "count", max(length - 1) AS width FROM plan WHERE id % 5 <> 0 GROUP BY ALL)
SELECT step, rank, "count", width, CASE WHEN rank = 1 THEN CASE WHEN "count" > 2 THEN 'batch' ELSE 'width' END WHEN "count" < 2 THEN 'batch' ELSE 'width' END AS reason FROM s WHERE (rank = 0 AND ("count" < 2 OR width NOT BETWEEN 60 AND 120)) OR (rank = 1 AND ("count" > 2 OR width > 110))""")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt groups outside of what their rank was calibrated for."""
    ranks = spark.sql("SELECT * FROM VALUES (0L, 'observed_isolated', 2L, 3L, 60L, 120L), (1L, 'observed_isolated', 1L, 2L, 1L, 110L) AS t(rank, evidence, min_batch, max_batch, min_width, max_width)")
    return fleet.domain_violations(planning.group_shapes(dealt(spark, sf_dir).filter("id % 5 <> 0")), ranks)


@query("""WITH r AS (SELECT p_partkey AS id, sha256('{"evidence":"declared","note":"part ' || p_partkey || '","ranks":[{"domain":{"max_batch":' || p_size || ',"max_width":128,"min_batch":1,"min_width":2},"model":{"linear":8,"max_samples":5,"overhead":20,"quadratic":' || p_partkey || '}},{"model":{"quadratic":0.5}}],"schema_version":1,"units":"proxy"}') AS sha256, p_partkey, p_size FROM part)
SELECT id, sha256, 0::BIGINT AS rank, p_partkey::DOUBLE AS quadratic, 5::BIGINT AS max_samples, p_size::BIGINT AS max_batch, true AS has_domain FROM r UNION ALL SELECT id, sha256, 1, 0.5, 8, NULL, false FROM r""")
def fleet_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with names in any order: their canonical hash, and the models and domains of their ranks."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit('{ "units": "proxy", "schema_version": 1, "ranks": [{"model": {"quadratic": '), key, F.lit(', "overhead": 20, "max_samples": 5, "linear": 8}, "domain": {"min_width": 2, "max_batch": '), size, F.lit(', "min_batch": 1, "max_width": 128}}, {"model": {"quadratic": 0.5}}], "note": "part '), key, F.lit('", "evidence":"declared"}'))
    profiles = fleet.checked_profiles(fleet.parsed_profiles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))))
    models = fleet.rank_models(profiles.withColumn("key", F.struct("id", "sha256")), "key")
    return models.select("key.id", "key.sha256", "rank", "quadratic", "max_samples", "max_batch", "has_domain")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
