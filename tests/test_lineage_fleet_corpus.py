"""Bounded buffers, chains of resumed runs, fleet profiles, sealed corpora and the provenance of paired runs."""

import hashlib
import json
import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skewline import guards
from skewline.operators import compare, fleet, journals, lineage
from skewline.plans import planning
from skewline.schemas import RANK_METRICS
from skewline.sources import rank_journal, sealed_corpus, sinks
from skewline.streaming import flushing

METRIC = {"warmup": False, "local_tokens": 4, "global_tokens": 8, "padded_tokens": 6, "step_ms": 2.5, "loss_sum": 1.0, "peak_memory_bytes": 2**60 + 1, "predicted_cost": None}
SCHEMA = "run string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RANK_METRICS.fields)


class Stream:
    """A stream of rank metrics through buffers, a trigger a call, started again each time."""

    def __init__(self, spark, path, every, steps, age=None):
        self.spark, self.path, self.every, self.age, self.fed = spark, path, every, age, 0
        (path / "in").mkdir(parents=True)
        self.runs = spark.createDataFrame(list(steps.items()), "run string, steps long")

    def put(self, rows):
        (self.path / "in" / f"{self.fed}.json").write_text("".join(json.dumps({**METRIC, "run": r, "rank": k, "step": s}) + "\n" for r, k, s in rows))
        self.fed += 1

    def writer(self):
        source = self.spark.readStream.schema(SCHEMA).json(str(self.path / "in"))
        write = flushing.bounded_flush(source, self.runs, self.every, self.age).writeStream.format("parquet").option("path", str(self.path / "out"))
        return write.option("checkpointLocation", str(self.path / "check"))

    def feed(self, rows):
        self.put(rows)
        self.writer().trigger(availableNow=True).start().awaitTermination(60)
        return self.out()

    def out(self):
        return self.spark.read.schema(SCHEMA + ", flush long, reason string, complete boolean").parquet(str(self.path / "out"))

    def flushes(self):
        """{(run, rank): [(reason, steps of a flush)]} in order, refused rows last."""
        found = {}
        for r in self.out().collect():
            found.setdefault((r["run"], r["rank"]), {}).setdefault((math.inf if r["flush"] is None else r["flush"], r["reason"]), []).append(r["step"])
        return {k: [(reason, sorted(steps)) for (_, reason), steps in sorted(v.items())] for k, v in found.items()}


def model_flushes(steps, every, end):
    """What a rank that writes a step at a time would flush."""
    held, out = [], []
    for s in steps:
        held.append(s)
        if s + 1 == end or (every and len(held) >= every):
            out.append(("end" if s + 1 == end else "rows", held))
            held = []
    return out


@pytest.mark.parametrize("every", [0, 3])
def test_buffers_flush_as_a_rank_would(spark, tmp_path, every):
    steps = {"a": 8, "b": 3, "open": None}
    stream = Stream(spark, tmp_path, every, steps)
    rows = {("a", 0): range(8), ("a", 1): range(6), ("b", 0): range(3), ("open", 0): range(7), ("unknown", 5): range(2, 9)}
    rng, left = random.Random(every), {k: list(v) for k, v in rows.items()}
    for _ in range(2):
        batch = []
        for (run, rank), own in left.items():
            n = rng.randint(0, len(own))
            batch += [(run, rank, s) for s in own[:n]]
            del own[:n]
        rng.shuffle(batch)
        stream.feed(batch)
    stream.feed([(run, rank, s) for (run, rank), own in left.items() for s in own])
    want = {k: model_flushes(v, every, steps.get(k[0]) or -1) for k, v in rows.items()}
    assert stream.flushes() == {k: v for k, v in want.items() if v}
    for r in stream.out().collect():
        assert {c: r[c] for c in METRIC} == METRIC  # longs beyond a double and nulls come through
    history = {(r["run"], r["rank"]): r for r in flushing.flush_history(stream.out()).collect()}
    assert {k: (r["flushes"], r["rows"], r["peak_buffered_rows"], r["refused"]) for k, r in history.items()} == {k: (len(v), sum(len(s) for _, s in v), max(len(s) for _, s in v), 0) for k, v in want.items() if v}
    assert {k for k, r in history.items() if r["complete"]} == {("a", 0), ("b", 0)}
    declared = flushing.flush_history(stream.out()).withColumn("flush_every", F.lit(every))
    assert guards.violations(declared, flushing.history_rules()).count() == 0
    told = {r["run"]: r["flushed_within"] for r in flushing.telemetry(flushing.flush_history(stream.out())).collect()}
    assert told["b"] is False and told["a"] is (every == 3)


def test_buffers_refuse_what_does_not_follow(spark, tmp_path):
    stream = Stream(spark, tmp_path, 2, {"a": 4})
    stream.feed([("a", 0, 0), ("a", 0, 2), ("a", 0, 0)])
    stream.feed([("a", 0, s) for s in (4, 3, 2, 1)])
    assert stream.flushes() == {("a", 0): [("rows", [0, 1]), ("end", [2, 3]), ("refused", [0, 2, 4])]}
    bad = flushing.flush_history(stream.out()).withColumn("flush_every", F.lit(3))
    assert sorted(r["rule"] for r in guards.violations(bad, flushing.history_rules()).collect()) == ["rows refused", "size of flushes"]


def test_old_rows_are_let_go_by_their_age(spark, tmp_path):
    stream = Stream(spark, tmp_path, 100, {}, age=200)
    stream.put([("a", 0, 0), ("a", 0, 1)])
    query = stream.writer().trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(60):  # timers fire in batches of their own, so the stream is left to run until they have
            time.sleep(0.5)
            if list((tmp_path / "out").glob("*.parquet")) and not stream.out().isEmpty():
                break
    finally:
        query.stop()
    assert stream.flushes() == {("a", 0): [("age", [0, 1])]}


def walk(parents, run):
    path = [run]
    while parents.get(path[0]) is not None:
        if parents[path[0]] not in parents:
            return path, "parent missing"
        if parents[path[0]] in path:
            return None, "cycle"
        path.insert(0, parents[path[0]])
    return path, "whole"


@pytest.mark.parametrize("seed", range(4))
def test_lineage_equals_walking(spark, seed):
    rng = random.Random(seed)
    names = [f"r{i}" for i in range(40)]
    parents = {n: rng.choice([None, "gone", *names[: i + 1 if seed < 2 else 40], *names[max(0, i - 1) : i] * 30]) for i, n in enumerate(names)}
    rows = [*parents.items(), next(iter(parents.items())), (None, "r1")]
    got = {r["run"]: r for r in lineage.lineage(spark.createDataFrame(rows, "run string, parent string")).collect()}
    assert set(got) == set(names)
    for n in names:
        path, status = walk(parents, n)
        assert (got[n]["status"], got[n]["path"], got[n]["origin"], got[n]["depth"]) == (status, path, path and path[0], path and len(path) - 1)


def test_lineage_of_nothing_and_of_two_parents(spark):
    none = spark.createDataFrame([], "run string, parent string")
    assert lineage.lineage(none).count() == 0
    with pytest.raises(ValueError, match="several parents"):
        lineage.lineage(spark.createDataFrame([("a", None), ("a", "b"), ("b", None)], "run string, parent string"))


def test_a_chain_of_three_resumed_runs(spark):
    manifests = spark.createDataFrame([("/r/a", None, 0), ("/r/b", "/r/a/checkpoint-4", 4), ("/r/c", "/r/b//checkpoint-7/", 7), ("/r/d", "/r/c/checkpoint-9", 9)], "run string, resume string, start_step long")
    runs = lineage.resumed_from(manifests)
    assert [tuple(r) for r in runs.orderBy("run").select("parent", "parent_step").collect()] == [(None, None), ("/r/a", 4), ("/r/b", 7), ("/r/c", 9)]
    lineages = lineage.lineage(runs.select("run", "parent"))
    assert lineages.filter("run = '/r/d'").first()["path"] == ["/r/a", "/r/b", "/r/c", "/r/d"]
    pieces = lineage.stretches(lineages, runs.select("run", "start_step"))
    assert sorted(tuple(r)[1:] for r in pieces.filter("run = '/r/c'").collect()) == [("/r/a", 0, 4), ("/r/b", 4, 7), ("/r/c", 7, None)]
    value = lambda run, step: float("nan") if step == 1 else step + (run == "/r/c" and step == 8) / 2
    spans = {"/r/a": range(6), "/r/b": range(4, 8), "/r/c": range(7, 10), "/r/d": range(9, 12)}
    rows = spark.createDataFrame([(run, k, s, float(value(run, s)), 5) for run, own in spans.items() for s in own for k in (0, 1)], "run string, rank long, step long, loss double, tokens long")
    reference = spark.createDataFrame([("x", k, s, float(value("", s)), 5) for s in range(12) for k in (0, 1) if (k, s) != (1, 11)], "reference string, rank long, step long, loss double, tokens long")
    histories = lineage.stitched(rows, pieces).withColumn("reference", F.lit("x"))
    got = {r["run"]: r for r in lineage.first_differences(histories, reference, ("loss", "tokens")).collect()}
    assert (got["/r/a"]["steps"], got["/r/a"]["equal"], got["/r/b"]["steps"], got["/r/b"]["equal"]) == (6, True, 8, True)
    assert (got["/r/c"]["first_step"], got["/r/c"]["paths"], got["/r/c"]["differing"], got["/r/c"]["missing"]) == (8, ["loss"], 2, 0)
    assert (got["/r/d"]["first_step"], got["/r/d"]["missing"], got["/r/d"]["steps"]) == (8, 1, 12)


def test_chains_are_held_against_their_checkpoints(spark):
    rows = [("a", None, None, 0, None, None), ("b", "a", 4, 4, 0, 5), ("c", "a", 4, 5, 0, 5), ("d", "x", 1, 1, None, None), ("e", "a", 7, 7, 0, 5), ("f", "a", 0, 0, 0, 5)]
    runs = spark.createDataFrame(rows, "run string, parent string, parent_step long, start_step long, parent_start long, parent_last long")
    got = sorted((r["run"], r["rule"]) for r in guards.violations(runs, lineage.chain_rules()).collect())
    assert got == [("c", "starts elsewhere than its checkpoint"), ("d", "parent missing"), ("e", "checkpoint after the parent's last step"), ("f", "checkpoint before the parent")]


PROFILE = {"schema_version": 1, "evidence": "declared", "units": "proxy", "ranks": [{"model": {"quadratic": 1.0, "linear": 8, "overhead": 20, "max_samples": 5}, "domain": {"min_batch": 1, "max_batch": 5, "min_width": 1, "max_width": 64}}, {"model": {"quadratic": 2.5, "max_samples": 5, "max_padded_tokens": 400}}], "note": "ü", "more": {"z": [1, {"b": None, "a": 1e-7}], "a": True}}


def saved(tmp_path, profile, indent=3):
    path = tmp_path / f"{hashlib.md5(json.dumps(profile).encode()).hexdigest()}.json"
    path.write_text(json.dumps(profile, indent=indent))
    return str(path)


def test_profiles_hash_as_their_sorted_text(spark, tmp_path):
    turned = dict(reversed(PROFILE.items()))
    want = hashlib.sha256(json.dumps(PROFILE, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = fleet.load_profiles(spark, [saved(tmp_path, PROFILE), saved(tmp_path, turned, None)])
    assert [r["sha256"] for r in got.collect()] == [want, want]
    one = fleet.profile_summaries(got).first()
    assert one["scope"] == "declared_compute_proxy" and len(one["ranks"]) == 2
    models = fleet.rank_models(got.limit(1)).orderBy("rank").collect()
    assert [(m["quadratic"], m["linear"], m["max_samples"], m["max_padded_tokens"], m["has_domain"], m["max_width"]) for m in models] == [(1.0, 8.0, 5, None, True, 64), (2.5, 0.0, 5, 400, False, None)]


@pytest.mark.parametrize(
    "change, why",
    [
        ({"schema_version": 2}, "schema"),
        ({"units": "s"}, "units"),
        ({"ranks": []}, "ranks"),
        ({"ranks": [{}]}, "rank without a model"),
        ({"evidence": "observed_isolated", "units": "ms"}, "observed scope"),
        ({"evidence": "observed_isolated", "units": "ms", "scope": "forward_backward_no_collectives", "workload": {"width": 8}, "hardware": [{"gpu": "x"}]}, "observed hardware"),
        ({"note": float("nan")}, "not JSON compliant"),
    ],
)
def test_bad_profiles_are_refused(spark, tmp_path, change, why):
    with pytest.raises(Exception, match=why):
        fleet.load_profiles(spark, saved(tmp_path, PROFILE | change)).collect()


def test_bad_models_are_refused(spark, tmp_path):
    bad = PROFILE | {"ranks": [{"model": {"quadratic": 0.0}}]}
    with pytest.raises(Exception, match="no work"):
        fleet.rank_models(fleet.load_profiles(spark, saved(tmp_path, bad))).collect()


def test_profiles_fit_their_runs(spark):
    rows = [("declared", None, 2, 2, "fsdp2", "w"), ("observed_isolated", "w", 2, 2, "ddp", "w"), ("observed_isolated", "w", 2, 3, "fsdp2", "v"), ("observed_isolated", None, 2, 2, "ddp", "w")]
    uses = spark.createDataFrame(rows, "evidence string, workload string, n_ranks long, world_size long, strategy string, signature string").withColumn("i", F.monotonically_increasing_id())
    got = [r["rule"] for r in guards.violations(uses, fleet.use_rules()).orderBy("i", "rule").collect()]
    assert got == ["rank count", "sharded run of an isolated calibration", "workload", "workload"]


def dealt(spark, lengths, world=2, batch=3):
    return planning.deal(spark.createDataFrame(list(enumerate(lengths)), "id long, length long"), world, batch, 17)


def test_plans_stay_within_the_domains_of_their_profile(spark, tmp_path):
    profile = fleet.load_profiles(spark, saved(tmp_path, PROFILE))
    plan = dealt(spark, [10 + i for i in range(24)])
    made = planning.profiled_plan(plan, profile)
    assert made.count() == 24 and planning.lost_samples(plan, made).count() == 0
    assert fleet.domain_violations(planning.group_shapes(made), fleet.rank_models(profile)).count() == 0
    narrow = PROFILE | {"ranks": [{**PROFILE["ranks"][0], "domain": {"min_batch": 1, "max_batch": 5, "min_width": 1, "max_width": 12}}, PROFILE["ranks"][1]]}
    with pytest.raises(ValueError, match="rank 0: width in . groups, first in step 0"):
        planning.profiled_plan(plan, fleet.load_profiles(spark, saved(tmp_path, narrow)))
    with pytest.raises(ValueError, match="a model for each rank"):
        planning.profiled_plan(dealt(spark, [9] * 24, world=3), profile)
    tight = PROFILE | {"ranks": [{"model": {"quadratic": 1.0, "max_samples": 2}}, {"model": {"quadratic": 1.0, "max_samples": 2}}]}
    with pytest.raises(ValueError, match="no feasible layout for 4 steps"):
        planning.profiled_plan(plan, fleet.load_profiles(spark, saved(tmp_path, tight)))


def test_domains_are_needed_by_observed_models_alone(spark):
    shapes = spark.createDataFrame([(0, 0, 2, 9), (0, 1, 2, 9), (0, 2, 2, 9), (0, 3, 7, 9), (0, 4, 2, 9)], "step long, rank long, count long, width long")
    domain = "min_batch long, max_batch long, min_width long, max_width long"
    ranks = spark.createDataFrame([(0, "declared", None, None, None, None), (1, "observed_isolated", None, None, None, None), (2, "observed_isolated", 1, 3, 10, 12), (3, "declared", 1, 3, 1, 12)], "rank long, evidence string, " + domain)
    assert sorted((r["rank"], r["reason"]) for r in fleet.domain_violations(shapes, ranks).collect()) == [(1, "no domain"), (2, "width"), (3, "batch"), (4, "rank not in the profile")]


@pytest.fixture
def corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sealed_corpus.lay_out, "__defaults__", (50,))
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, rng.randbytes(rng.choice([0, 1, 2, 40, 700, 3000]))) for i in range(60)], "doc long, content binary")
    sinks.write_corpus(docs, f"{tmp_path}/c", 31, 2)
    return tmp_path / "c"


def window_files(corpus):
    return sorted(Path(corpus, "windows").glob("*.parquet"))


def test_a_sealed_corpus_reads_one_file_for_one_sample(spark, corpus):
    opened = sealed_corpus.SealedCorpus(spark, str(corpus))
    rows = {r["sample_id"]: (r["doc"], r["length"], bytes(r["tokens"])) for r in opened.rows().collect()}
    assert sorted(rows) == list(range(len(opened))) and len(window_files(corpus)) > 5
    assert opened.files.agg(F.max("rows")).first()[0] <= 50
    for i in (0, 49, 50, len(opened) - 1):
        one = opened.sample(i)
        assert sum("/windows/" in f for f in one.inputFiles()) == 1
        assert [(r["doc"], r["length"], bytes(r["tokens"])) for r in one.collect()] == [rows[i]]
    for i in (-1, len(opened), True, "1"):
        with pytest.raises(IndexError):
            opened.sample(i)


def flip(path, keep_time=False):
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)


@pytest.mark.parametrize("fault, why", [("byte", "content"), ("gone", "missing"), ("more", "not sealed"), ("manifest", "manifest changed"), ("table", "table of files changed")])
def test_a_changed_corpus_is_not_opened(spark, corpus, fault, why):
    first = window_files(corpus)[0]
    for crc in corpus.rglob(".*.crc"):
        crc.unlink()
    if fault == "byte":
        flip(first)
    elif fault == "gone":
        first.unlink()
    elif fault == "more":
        (corpus / "windows" / "part-x.parquet").write_bytes(first.read_bytes())
    elif fault == "manifest":
        told = next((corpus / "manifest").glob("part-*"))
        told.write_text(told.read_text().replace('"max_length": 31', '"max_length": 32'))
    else:
        rows = spark.read.parquet(f"{corpus}/files").toPandas()
        rows["tokens"] += 1
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{corpus}/files")
    with pytest.raises(ValueError, match=why):
        sealed_corpus.SealedCorpus(spark, str(corpus))


def test_a_corpus_that_changes_while_open_is_refused(spark, corpus):
    for crc in corpus.rglob(".*.crc"):
        crc.unlink()
    opened = sealed_corpus.SealedCorpus(spark, str(corpus))
    holder = opened.files.filter("first_id <= 60 AND last_id >= 60").first()["file"]
    other = next(f for f in window_files(corpus) if f.name != holder)
    time.sleep(0.01)
    other.write_bytes(other.read_bytes())
    assert opened.sample(60).count() == 1  # its own file is as it was
    with pytest.raises(Exception, match="changed while open"):
        opened.rows().collect()
    (corpus / "windows" / holder).unlink()
    with pytest.raises(ValueError, match="changed while open"):
        opened.rows()


def test_extents_must_follow(spark):
    files = spark.createDataFrame([("a", 0, 4, 5), ("b", 6, 8, 3), ("c", 9, 12, 3)], "file string, first_id long, last_id long, rows long")
    assert sorted(tuple(r) for r in sealed_corpus.extent_errors(files).collect()) == [("b", "ids don't follow"), ("c", "ids have gaps")]


def journaled_run(path, seed, planner, ms, pieces=1, instrumented=None, complete=True):
    """A run of two ranks and six steps whose journals were written in `pieces`."""
    path.mkdir(parents=True)
    progress = []
    for rank in (0, 1):
        rows = [{**METRIC, "rank": rank, "step": s, "step_ms": ms, "predicted_cost": 1.0} for s in range(6)]
        size = 6 // pieces
        for i in range(pieces):
            progress.append(sinks.append_journal(path, rank, rows[i * size : (i + 1) * size], 0, complete and i + 1 == pieces))
        progress[rank:] = progress[-1:]
    told = {"schema_version": 1, "evidence": "observed", "world_size": 2, "timing": "wall", "instrumented": pieces > 1 if instrumented is None else instrumented, "start_step": 0, "config": {"steps": "6", "warmup": "0", "planner": planner, "seed": str(seed)}, "hardware": [{"rank": 0, "hostname": "h"}, {"rank": 1, "hostname": "h"}]}
    (path / "manifest.json").write_text(json.dumps({**told, "telemetry": {"flush_every": 6 // pieces, "rank_progress": progress}}))
    return str(path)


def test_provenance_of_pairs_comes_from_their_journals(spark, tmp_path):
    from skewline import cli

    def report(name, a, b):
        pairs = [(journaled_run(tmp_path / f"{name}-a{i}", i, "random", 10.0, **a), journaled_run(tmp_path / f"{name}-b{i}", i, "balanced", 5.0, **b)) for i in (1,)]
        runs = {d: cli.checked_run(spark, d)[0] for pair in pairs for d in pair}
        return compare.pair_report(compare.paired_runs(spark, pairs, runs, {d: cli.flushed_within(spark, d) for d in runs}), 100)

    assert report("same", {}, {})["geometric_mean_speedup"] == pytest.approx(2)
    assert report("both", {"pieces": 3}, {"pieces": 2})["geometric_mean_speedup"] == pytest.approx(2)
    with pytest.raises(ValueError, match="instrumented.*one run wrote within"):
        report("one", {"pieces": 3}, {})
    with pytest.raises(ValueError, match="candidate is not instrumented as its journals tell.*one run wrote within"):
        report("lied", {}, {"pieces": 3, "instrumented": False})
    with pytest.raises(ValueError, match="baseline is not instrumented as its journals tell"):
        report("both lied", {"pieces": 2, "instrumented": False}, {"pieces": 2, "instrumented": False})


def test_provenance_of_journals(spark, tmp_path):
    journaled_run(tmp_path / "r" / "once", 0, "random", 1.0)
    journaled_run(tmp_path / "r" / "twice", 0, "random", 1.0, pieces=2)
    got = {r["run"].rsplit("/", 1)[1]: (r["flushes"], r["flushed_within"]) for r in journals.provenance(rank_journal.journal_status(spark, f"{tmp_path}/r/*")).collect()}
    assert got == {"once": (1, False), "twice": (2, True)}
