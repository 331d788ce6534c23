"""Journals as a data source: committed prefixes, status, and streams that are stopped and started again."""

import hashlib
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from skewline.functions.resumable_sha256 import ResumableSha256
from skewline.operators import journals, selection
from skewline.schemas import RANK_METRICS
from skewline.sources import rank_journal, sinks
from skewline.streaming import metrics as streaming

METRIC = {"warmup": False, "local_tokens": 4, "global_tokens": 8, "padded_tokens": 6, "step_ms": 2.5, "loss_sum": 1.0, "peak_memory_bytes": 7, "predicted_cost": 3.0}


def row(rank, step, **changes):
    return {**METRIC, "rank": rank, "step": step, **changes}


def lines(rows):
    return b"".join(json.dumps(r, sort_keys=True).encode() + b"\n" for r in rows)


def read(spark, path):
    return sorted((r.run, r.rank, r.step) for r in rank_journal.committed_rows(spark, str(path)).collect())


def status(spark, path):
    return {r["rank"]: r for r in rank_journal.journal_status(spark, str(path)).collect()}


def marker(path, rank):
    return json.loads((path / f"progress-rank{rank}.json").read_text())


def change(path, rank, /, **changes):
    (path / f"progress-rank{rank}.json").write_text(json.dumps({**marker(path, rank), **changes}))


def complete_run(path, ranks=2, steps=5, world=None):
    path.mkdir(exist_ok=True)
    progress = [sinks.append_journal(path, rank, [row(rank, s) for s in range(3, 3 + steps)], 3, True) for rank in range(ranks)]
    (path / "manifest.json").write_text(json.dumps({"world_size": world or ranks, "start_step": 3, "telemetry": {"flush_every": 1, "rank_progress": progress}}))


@pytest.mark.parametrize("plain", [True, False])
def test_hash_is_taken_up_again(plain):
    rng = random.Random(1)
    for n in [*range(0, 130, 3), 55, 56, 63, 64, 65, 119, 120, 4096]:
        data, cut = rng.randbytes(n), rng.randint(0, n)
        first = ResumableSha256(plain=plain)
        first.update(data[:cut])
        for other in (plain, not plain):  # the state is the same, whoever goes on
            again = ResumableSha256(first.state, cut, data[cut - cut % 64 : cut], plain=other)
            again.update(data[cut:])
            assert again.hexdigest() == again.hexdigest() == hashlib.sha256(data).hexdigest()
    with pytest.raises(ValueError):
        ResumableSha256("", 3, b"")


def test_an_open_journal_hashes_new_bytes_only(tmp_path):
    journal = sinks.Journal(tmp_path, 0, 7)
    with pytest.raises(ValueError, match="gaps"):
        journal.write([row(0, 8)])
    assert not (tmp_path / "metrics-rank0.jsonl").exists()
    assert journal.write([])["last_step"] == 6
    for step in range(7, 12):
        told = journal.write([row(0, step)], complete=step == 11)
    assert told["sha256"] == hashlib.sha256((tmp_path / "metrics-rank0.jsonl").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="closed"):
        journal.write([row(0, 12)])


def test_only_committed_bytes_are_read(spark, tmp_path):
    big = 9000  # some 2 MB: more than two blocks
    sinks.append_journal(tmp_path, 0, [row(0, s) for s in range(big)])
    sinks.append_journal(tmp_path, 1, [row(1, s) for s in range(2)])
    for rank in (0, 1):
        with (tmp_path / f"metrics-rank{rank}.jsonl").open("ab") as f:
            f.write(lines([row(rank, big)]) + b'{"torn')
    got = rank_journal.committed_rows(spark, str(tmp_path))
    assert got.schema == spark.createDataFrame([], RANK_METRICS).withColumn("run", F.lit("").cast("string")).schema or got.columns == [*RANK_METRICS.names, "run"]
    assert got.groupBy("rank").count().orderBy("rank").collect() == [(0, big), (1, 2)]
    first = got.filter("rank = 1 and step = 0").first().asDict()
    assert first == {**row(1, 0), "run": str(tmp_path)}
    assert {k: (v.status, v.rows, v.last_step) for k, v in status(spark, tmp_path).items()} == {0: ("partial", big, big - 1), 1: ("partial", 2, 1)}
    assert rank_journal.committed_rows(spark, str(tmp_path / "none*")).collect() == []


@pytest.mark.parametrize(
    "fault, why",
    [
        ("byte", "isn't what its marker says|can't be read"),
        ("short", "shorter"),
        ("hash", "isn't what"),
        ("steps", "don't fit"),
        ("rank", "another rank"),
        ("version", "another"),
        ("numbers", "numbers are bad"),
        ("order", "out of order"),
        ("gap", "out of order"),
        ("other rank", "out of order"),
        ("cut", "cut off"),
        ("long", "too long"),
        ("blank", "blank"),
        ("rows", "other rows"),
        ("kind", "can't be read"),
    ],
)
def test_bad_prefixes_are_refused(spark, tmp_path, fault, why):
    sinks.append_journal(tmp_path, 0, [row(0, s) for s in range(4)])
    sinks.append_journal(tmp_path, 1, [row(1, s) for s in range(4)])
    data = tmp_path / "metrics-rank0.jsonl"
    content = data.read_bytes()
    rows = [row(0, s) for s in range(4)]
    new = {
        "byte": content.replace(b"2.5", b"3.5", 1),
        "short": content[:-1],
        "order": lines([rows[0], rows[2], rows[1], rows[3]]),
        "gap": lines([rows[0], *[row(0, s) for s in (2, 3, 4)]]),
        "other rank": lines([*rows[:3], row(1, 3)]),
        "cut": content[:-1] + b" ",
        "long": lines([*rows[:3], {**rows[3], "note": "x" * 70_000}]),
        "blank": lines(rows[:2]) + b"\n" + lines(rows[2:]),
        "kind": content.replace(b'"step": 2', b'"step": "2"', 1),
    }.get(fault)
    marks = {"hash": {"sha256": "0" * 64}, "steps": {"last_step": 9}, "rank": {"rank": 1}, "version": {"schema_version": 2}, "numbers": {"bytes": -1}, "rows": {"rows": 5, "last_step": 4}}.get(fault, {})
    if new is not None:
        data.write_bytes(new)
        if fault not in ("byte", "short"):
            marks = {"bytes": len(new), "sha256": hashlib.sha256(new).hexdigest()}
    change(tmp_path, 0, **marks)
    with pytest.raises(Exception, match=why):
        read(spark, tmp_path)
    told = status(spark, tmp_path)
    assert told[1].status == "partial" and (told[0].status, told[0].rows) == ("invalid", 0) and told[0].error
    worlds = rank_journal.journal_status(spark, str(tmp_path)).select("run", F.lit(2).cast("long").alias("world_size")).distinct()
    run = journals.run_status(rank_journal.journal_status(spark, str(tmp_path)), worlds).first()
    assert (run.status, run.durable_through_step) == ("invalid", None)


def test_complete_runs_allow_nothing_behind_their_markers(spark, tmp_path):
    runs = {name: tmp_path / name for name in ("good", "tail", "open", "other", "lost")}
    for path in runs.values():
        complete_run(path)
    with (runs["tail"] / "metrics-rank1.jsonl").open("ab") as f:
        f.write(b"{")
    change(runs["open"], 0, complete=False)
    change(runs["other"], 0, flushes=2)
    (runs["lost"] / "progress-rank1.json").unlink()
    (runs["lost"] / "failure-rank1.json").write_text('{"type": "OSError"}')
    assert len(read(spark, runs["good"])) == 10
    for name, why in (("tail", "behind its marker"), ("open", "isn't the manifest's"), ("other", "isn't the manifest's"), ("lost", "lacks")):
        with pytest.raises(Exception, match=why):
            read(spark, runs[name])
    told = rank_journal.journal_status(spark, str(tmp_path / "*"))
    worlds = told.select("run", F.lit(2).cast("long").alias("world_size")).distinct()
    by_run = {r.run.rsplit("/", 1)[1]: (r.status, r.durable_through_step) for r in journals.run_status(told, worlds).collect()}
    assert by_run == {"good": ("complete", 7), "tail": ("invalid", None), "open": ("invalid", None), "other": ("invalid", None), "lost": ("invalid", None)}
    assert [r.failure for r in told.filter("failure is not null").collect()] == ['{"type": "OSError"}']


def test_attempts_tell_ranks_without_rows(spark, tmp_path):
    (tmp_path / "attempt.json").write_text('{"world_size": 3}')
    sinks.append_journal(tmp_path, 1, [row(1, 0)])
    told = rank_journal.journal_status(spark, str(tmp_path))
    assert {r["rank"]: r.status for r in told.collect()} == {0: "no_committed_metrics", 1: "partial", 2: "no_committed_metrics"}
    run = journals.run_status(told, told.select("run", F.lit(3).cast("long").alias("world_size")).distinct()).first()
    assert (run.status, run.ranks, run.durable_through_step) == ("partial", 1, None)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in RANK_METRICS.names) for r in rows], RANK_METRICS)


def test_batch_writes_append(spark, tmp_path):
    shuffled = [row(rank, step, predicted_cost=None if step % 2 else 1.0) for step in range(6) for rank in range(3)]
    random.Random(2).shuffle(shuffled)
    both = frame(spark, shuffled).withColumn("run", F.when(F.col("rank") == 2, "b").otherwise("a"))
    rank_journal.write_rows(both.filter("step < 4"), str(tmp_path))
    rank_journal.write_rows(both.filter("step >= 4"), str(tmp_path))
    assert read(spark, tmp_path / "*") == sorted((f"{tmp_path}/{'b' if r == 2 else 'a'}", r, s) for r in range(3) for s in range(6))
    assert marker(tmp_path / "a", 1)["flushes"] == 2
    for bad, why in (([row(0, 8)], "gaps"), ([row(0, 6), row(0, 6)], "gaps"), ([row(0, 6, step_ms=-1.0)], "positive"), ([row(0, 3)], "gaps"), ([row(0, 4, loss_sum=9.0), row(0, 5)], "committed")):
        with pytest.raises(Exception, match=why):
            rank_journal.write_rows(frame(spark, bad).withColumn("run", F.lit("a")), str(tmp_path))
    assert rank_journal.seal(str(tmp_path / "*")) == 3
    with pytest.raises(Exception, match="complete"):
        rank_journal.write_rows(frame(spark, [row(0, 6)]).withColumn("run", F.lit("a")), str(tmp_path))


def test_sink_writes_every_row_once(spark, tmp_path):
    """Killed between data and markers, and among markers."""
    source, target, checkpoint = tmp_path / "in", tmp_path / "run", tmp_path / "checkpoint"
    source.mkdir()
    target.mkdir()

    def run():
        rows = spark.readStream.schema(RANK_METRICS).json(str(source))
        rank_journal.stream_to_journals(rows, str(target), str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    def feed(name, steps):
        (source / f"{name}.json").write_bytes(lines([row(rank, s) for s in steps for rank in (1, 0)]))

    def whole(steps):
        for rank in (0, 1):
            content = (target / f"metrics-rank{rank}.jsonl").read_bytes()
            told = marker(target, rank)
            assert content == lines([row(rank, s) for s in range(steps)]) and told["rows"] == steps and told["bytes"] == len(content)
            assert told["sha256"] == hashlib.sha256(content).hexdigest()

    feed("a", range(5))
    run()
    whole(5)
    before = {rank: (target / f"progress-rank{rank}.json").read_bytes() for rank in (0, 1)}
    feed("b", range(5, 9))
    # Data of the batch to come, one part whole and one torn, and no marker.
    rank_journal.extend(target, 0, [row(0, s) for s in range(5, 9)])
    with (target / "metrics-rank1.jsonl").open("ab") as f:
        f.write(lines([row(1, 5)])[:-9])
    run()
    whole(9)
    # The batch ran, but its commit isn't on record, and one of its markers isn't out.
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    (target / "progress-rank1.json").write_bytes(before[1])
    run()
    whole(9)
    feed("c", range(9, 11))
    run()
    whole(11)
    assert len(read(spark, target)) == 22


def test_stream_reads_every_row_once(spark, tmp_path):
    runs, out, checkpoint = tmp_path / "runs", tmp_path / "out", tmp_path / "checkpoint"
    (runs / "x").mkdir(parents=True)
    (runs / "y").mkdir()

    def run():
        rows = rank_journal.stream_rows(spark, f"{runs}/*")
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run[-1], r.rank, r.step) for r in spark.read.parquet(str(out)).collect())

    sinks.append_journal(runs / "x", 0, [row(0, s) for s in range(3)])
    with (runs / "x" / "metrics-rank0.jsonl").open("ab") as f:
        f.write(b'{"not committed')
    want = [("x", 0, s) for s in range(3)]
    assert run() == want
    assert run() == want
    sinks.append_journal(runs / "x", 0, [row(0, s) for s in range(3, 7)])
    sinks.append_journal(runs / "x", 1, [row(1, s) for s in range(10, 12)], 10)
    sinks.append_journal(runs / "y", 0, [row(0, 0)])
    want = sorted([("x", 0, s) for s in range(7)] + [("x", 1, 10), ("x", 1, 11), ("y", 0, 0)])
    assert run() == want
    shutil.rmtree(runs / "y")
    (runs / "y").mkdir()
    sinks.append_journal(runs / "y", 0, [row(0, 4)], 4)
    with pytest.raises(Exception, match="replaced"):
        run()


def test_growing_journals_feed_step_aggregates(spark, tmp_path):
    checkpoint, name = tmp_path / "checkpoint", "journal_steps"

    def run():
        steps = streaming.stream_step_aggregates(rank_journal.stream_rows(spark, str(tmp_path / "run")))
        found = {}
        keep = lambda batch, _: found.update({r.step: (r.rank_rows, r.tokens) for r in batch.collect()})
        steps.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).queryName(name).trigger(availableNow=True).start().awaitTermination()
        return found

    (tmp_path / "run").mkdir()
    for rank in (0, 1):
        sinks.append_journal(tmp_path / "run", rank, [row(rank, s, warmup=s == 0) for s in range(3)])
    assert run() == {1: (2, 8), 2: (2, 8)}
    sinks.append_journal(tmp_path / "run", 0, [row(0, 3), row(0, 4)])
    assert run() == {3: (1, 4), 4: (1, 4)}
    sinks.append_journal(tmp_path / "run", 1, [row(1, 3)])
    assert run() == {3: (2, 8)}


def test_status_follows_the_markers(spark, tmp_path):
    runs = {name: tmp_path / "runs" / name for name in ("a", "b")}
    for path in runs.values():
        path.mkdir(parents=True)
    worlds = spark.createDataFrame([(str(p), 2) for p in runs.values()], "run string, world_size long")

    def run():
        found = {}
        keep = lambda batch, _: found.update({r.run[-1]: (r.ranks, r.durable_through_step, r.status) for r in batch.collect()})
        told = streaming.live_status(rank_journal.stream_progress(spark, f"{tmp_path}/runs/*"), worlds)
        told.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return found

    put = lambda name, rank, steps, done=False: sinks.append_journal(runs[name], rank, [row(rank, s) for s in steps], 0, done)
    put("a", 0, range(3))
    put("b", 1, range(2))
    assert run() == {"a": (1, None, "partial"), "b": (1, None, "partial")}
    put("a", 1, range(2), True)
    assert run() == {"a": (2, 1, "partial")}
    put("a", 0, range(3, 5), True)
    put("b", 0, range(4))
    assert run() == {"a": (2, 1, "complete"), "b": (2, 1, "partial")}
    put("b", 1, range(2, 3))
    broken = (runs["b"] / "metrics-rank1.jsonl").read_bytes()[:-3] + b"???"
    (runs["b"] / "metrics-rank1.jsonl").write_bytes(broken)
    assert run()["b"][2] == "invalid"
    put("b", 0, range(4, 5), True)
    assert run() == {}  # invalid stays


def test_chained_operators_tell_the_frontier(spark, tmp_path):
    (tmp_path / "in").mkdir()
    worlds = spark.createDataFrame([("r", 2)], "run string, world_size long")

    def run(name, rows):
        (tmp_path / "in" / f"{name}.json").write_bytes(lines(rows))
        stream = spark.readStream.schema(RANK_METRICS).json(str(tmp_path / "in")).withColumn("run", F.lit("r"))
        found = []
        keep = lambda batch, _: found.extend((r.durable_through_step, r.status) for r in batch.collect())
        streaming.admitted_status(stream, worlds).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return found

    assert run("1", [row(0, s) for s in range(3)]) == [(None, "partial")]
    assert run("2", [row(1, 1), row(1, 0)]) == [(1, "partial")]
    assert run("3", [row(1, 4)]) == [(1, "invalid")]


# Selection and runs as the commands check them


@pytest.mark.parametrize("enough", [1, 40, 10**6])
def test_selection_equals_sorting(spark, enough):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 300 + [6.0] * 2, "wide": (10 ** rng.uniform(-300, 300, 700)).tolist(), "plain": rng.normal(size=1500).tolist(), "few": rng.integers(0, 4, 400).tolist()}
    rows = [(g, float(v), "x") for g, values in groups.items() for v in values] + [("none", None, "x"), ("two", None, "x")]
    table = spark.createDataFrame(rows, "run string, step_ms double, place string").repartition(5)
    points = (0.0, 0.05, 0.5, 0.95, 0.999, 1.0)
    got = {(r.run, r.q): r.value for r in selection.quantiles(table, "run", "step_ms", points, enough).collect()}
    assert set(got) == {(g, q) for g in groups for q in points}
    for g, values in groups.items():
        values = sorted(values)
        for q in points:
            at = (len(values) - 1) * q
            a, b, part = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)], at - int(at)
            assert got[g, q] == ((a + b) / 2 if q == 0.5 else a + (b - a) * part)


def test_selection_of_an_empty_table(spark):
    assert selection.quantiles(spark.createDataFrame([], "run string, step_ms double"), "run", "step_ms", (0.5,)).collect() == []
    with pytest.raises(ValueError):
        selection.quantiles(spark.createDataFrame([], "run string, step_ms double"), "run", "step_ms", (1.5,))


def full_run(path, keep=lambda r: True, start=0, steps=10, warmup=4, journal=True, **changes):
    """Two ranks; changes: step -> fields."""
    path.mkdir()
    progress = []
    for rank in (0, 1):
        rows = [{**row(rank, s, warmup=s < warmup), **(changes.get(f"s{s}") or {})} for s in range(start, steps)]
        rows = [r for r in rows if keep(r["step"])]
        if journal:
            progress.append(sinks.append_journal(path, rank, rows, rows[0]["step"], True))
        else:
            (path / f"metrics-rank{rank}.jsonl").write_bytes(lines(rows))
    told = {"schema_version": 1, "evidence": "observed", "world_size": 2, "timing": "wall", "instrumented": False, "start_step": start, "config": {"steps": str(steps), "warmup": str(warmup), "planner": "random", "seed": "1"}}
    (path / "manifest.json").write_text(json.dumps(told | ({"telemetry": {"flush_every": 1, "rank_progress": progress}} if journal else {})))
    return str(path)


@pytest.mark.parametrize("journal", [True, False])
def test_commands_check_runs_against_their_manifests(spark, tmp_path, journal):
    from skewline import cli

    for start in (0, 3, 6):  # a resumed run's warm-up ends where the run's does
        rows, _ = cli.checked_run(spark, full_run(tmp_path / f"good{start}", start=start, journal=journal))
        assert rows.count() == 2 * (10 - start) and rows.filter("warmup").count() == 2 * max(0, 4 - start)
    bad = {
        "tail": ({"keep": lambda s: s < 6}, "steps are missing"),
        "head": ({"keep": lambda s: s >= 2}, "steps are missing"),
        "tokens": ({"s5": {"local_tokens": 0, "global_tokens": 0}}, "no tokens"),
        "warm": ({"steps": 4}, "no measured steps"),
        "flag": ({"s3": {"warmup": False}}, "rows are bad"),
    }
    for name, (how, why) in bad.items():
        with pytest.raises(ValueError, match=why):
            cli.checked_run(spark, full_run(tmp_path / name, journal=journal, **how))
    if journal:
        path = tmp_path / "good0"
        with (path / "metrics-rank0.jsonl").open("ab") as f:
            f.write(b"{")
        with pytest.raises(ValueError, match="journals are bad"):
            cli.checked_run(spark, str(path))


def test_inspect_run(spark, tmp_path):
    from skewline.cli import main

    path = full_run(tmp_path / "run")
    assert main(["inspect-run", path, "--out", f"{tmp_path}/a"]) == 0
    got = json.loads((tmp_path / "a/inspect-run.json").read_text())
    assert (got["status"], got["durable_through_step"], [r["status"] for r in got["ranks"]]) == ("complete", 9, ["complete"] * 2)
    (tmp_path / "run/manifest.json").rename(tmp_path / "run/attempt.json")
    (tmp_path / "run/progress-rank1.json").unlink()
    main(["inspect-run", path, "--out", f"{tmp_path}/b"])
    got = json.loads((tmp_path / "b/inspect-run.json").read_text())
    assert (got["status"], got.get("durable_through_step"), [r["status"] for r in got["ranks"]]) == ("partial", None, ["complete", "no_committed_metrics"])


def test_many_journals_share_tasks(tmp_path):
    """A task a journal costs more than its rows where journals are short: of many, a task takes some, and none is left out."""
    for run in range(50):
        (tmp_path / f"run{run}").mkdir()
        for rank in range(7):
            (tmp_path / f"run{run}" / f"progress-rank{rank}.json").write_text("{}")
    tasks = rank_journal.RowReader(f"{tmp_path}/*").partitions()
    dealt = sorted((j.root, j.rank) for t in tasks for j in t.some)
    assert len(tasks) == rank_journal.TASKS and dealt == sorted((f"{tmp_path}/run{run}", rank) for run in range(50) for rank in range(7))
    few = rank_journal.RowReader(f"{tmp_path}/run1").partitions()
    assert [len(t.some) for t in few] == [1] * 7
