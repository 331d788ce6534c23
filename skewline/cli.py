"""Command line: the analytic sub-commands over files, as Spark jobs. Training itself is not part of this engine."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .guards import require


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skewline", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *arguments: [(p := sub.add_parser(name)), *(p.add_argument(a, **k) for a, k in arguments)]
    out, source = ("--out", {"required": True}), ("input", {})
    add("spark-aggregate", source, out)
    add("summarize", source, out, ("--aggregate-only", {"action": "store_true"}))
    add("compare", ("--baseline", {"nargs": "+", "required": True}), ("--candidate", {"nargs": "+", "required": True}), ("--bootstrap", {"type": int, "default": 4000}), out)
    add("analyze", source, out, ("--rank", {"type": int, "default": 0}), ("--device", {"type": int}))
    add("nsys-import", source, out, ("--pid", {"type": int}))
    add("corpus-build", ("inputs", {"nargs": "+"}), out, ("--max-length", {"type": int, "default": 128}), ("--min-length", {"type": int, "default": 2}))
    add("inspect-run", source, out)
    add("calibrate", source, out)
    add("schedule-audit", out, ("--seeds", {"type": int, "nargs": "+", "default": [17, 23, 31, 43]}), ("--node-budget", {"type": int, "default": 100_000}))
    add("demo", out)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"skewline {a.command}").getOrCreate()
    result = COMMANDS[a.command](spark, a)
    if result is not None:
        from .sources.sinks import write_html, write_json

        write_json(f"{a.out}/{a.command}.json", result)
        rows = result if isinstance(result, list) else [result]
        write_html(a.command, {a.command: rows}, f"{a.out}/{a.command}.html")
    return 0


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def aggregate(spark, a):
    from .operators.metrics import step_aggregates
    from .sources.files import rank_metrics
    from .sources.sinks import write_by_run

    write_by_run(step_aggregates(rank_metrics(spark, a.input)), a.out)


def checked_run(spark, path):
    """(rank rows, manifest) of a run's directory, refused unless it has the files, journals, steps and rows that its manifest tells."""
    from .operators import metrics
    from .sources import files, rank_journal

    manifest = files.manifests(spark, f"{path}/{files.MANIFEST_FILE}").first()
    rows = files.rank_metrics(spark, f"{path}/{files.METRICS_FILE}")
    ranks = files.file_ranks(spark, f"{path}/{files.METRICS_FILE}")
    worlds = spark.createDataFrame([(r["run"], manifest["world_size"]) for r in ranks.select("run").distinct().collect()], "run string, world_size long")
    bad = files.rank_set_errors(ranks, worlds).first()
    require(bad is None, f"rank files don't match the world size: {bad}")
    if manifest["telemetry"] is not None and manifest["telemetry"]["rank_progress"] is not None:
        bad = rank_journal.journal_status(spark, path).filter("status <> 'complete'").first()
        require(bad is None, f"the run's journals are bad: {bad}")
        rows = rank_journal.committed_rows(spark, path).withColumn("run", F.lit(manifest["run"]))
    first, warmup, steps = manifest["start_step"] or 0, int(manifest["config"].get("warmup") or 0), manifest["config"].get("steps")
    bad = metrics.run_violations(rows, manifest["world_size"], warmup).first()
    require(bad is None, f"the run's rows are bad: {bad}")
    last = int(steps) if steps is not None else (rows.agg(F.max("step")).first()[0] or 0) + 1
    runs = rows.select("run").limit(1).select("run", *[F.lit(n).cast("long").alias(k) for k, n in (("start_step", first), ("steps", last), ("warmup", warmup))])
    require(not runs.isEmpty(), "the run has no rows")
    bad = metrics.completeness_violations(rows, runs).first()
    require(bad is None, f"the run's steps are bad: {bad}")
    return rows, manifest


def flushed_within(spark, path):
    """Whether the run's ranks wrote before its end, told by its journals; None for a run without."""
    from .operators.journals import provenance
    from .sources.rank_journal import journal_status

    told = provenance(journal_status(spark, path)).first()
    return told and told["flushed_within"]


def summarize(spark, a):
    from .operators.metrics import run_summary, step_items

    rows, _ = checked_run(spark, a.input)
    if not a.aggregate_only:
        step_items(rows).write.mode("errorifexists").json(f"{a.out}/steps")
    return _rows(run_summary(rows))[0]


def compare(spark, a):
    from .operators.compare import pair_report, paired_runs

    require(len(a.baseline) == len(a.candidate), "provide as many baseline as candidate runs")
    runs = {d: checked_run(spark, d)[0] for d in {*a.baseline, *a.candidate}}
    within = {d: flushed_within(spark, d) for d in runs}
    return pair_report(paired_runs(spark, list(zip(a.baseline, a.candidate, strict=True)), runs, within), a.bootstrap)


def analyze(spark, a):
    from .operators.traces import analyze as run
    from .sources.files import trace_events

    return _rows(run(trace_events(spark, a.input), a.rank, a.device))


def nsys(spark, a):
    from .operators.profiler import trace_document
    from .sources.profiler_sqlite import trace_events

    Path(a.out).mkdir(parents=True, exist_ok=False)
    (Path(a.out) / "trace.json").write_text(trace_document(trace_events(spark, a.input, a.pid)).first()[0])


def corpus(spark, a):
    from .sources.files import documents
    from .sources.sinks import write_corpus

    return write_corpus(documents(spark, a.inputs), f"{a.out}/corpus", a.max_length, a.min_length)


def inspect(spark, a):
    """What of a run is durable, complete or not: each journal checked against its marker, and those of a complete run against its manifest."""
    from .operators.journals import run_status
    from .sources import files
    from .sources.rank_journal import journal_status

    ranks = journal_status(spark, a.input).cache()
    told = next((p for p in (Path(a.input, files.MANIFEST_FILE), Path(a.input, files.ATTEMPT_FILE)) if p.exists()), None)
    world = json.loads(told.read_text())["world_size"] if told else ranks.count()
    run = run_status(ranks, ranks.select("run", F.lit(world).cast("long").alias("world_size")).distinct())
    return {**_rows(run)[0], "ranks": _rows(ranks.drop("run", "completed").orderBy("rank"))}


def calibrate(spark, a):
    from .operators.calibration import fit_ranks
    from .schemas import CALIBRATION

    return _rows(fit_ranks(spark.read.schema(CALIBRATION).json(a.input)))


def audit(spark, a):
    from .plans.campaign import oracle_statuses, run_campaign, summarize

    results = run_campaign(spark, tuple(a.seeds), a.node_budget).cache()
    return {"seeds": a.seeds, "node_budget": a.node_budget, "methods": _rows(summarize(results)), "oracle_status": _rows(oracle_statuses(results))}


def demo(spark, a):
    from .operators.traces import analyze as run
    from .sources.generators import demo_trace

    return _rows(run(demo_trace(spark)))


COMMANDS = {"spark-aggregate": aggregate, "summarize": summarize, "compare": compare, "analyze": analyze, "nsys-import": nsys, "corpus-build": corpus, "inspect-run": inspect, "calibrate": calibrate, "schedule-audit": audit, "demo": demo}

if __name__ == "__main__":
    raise SystemExit(main())
