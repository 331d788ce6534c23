"""File sources: rank metrics, manifests, traces, documents, journals, checkpoints. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..guards import require
from ..schemas import CHECKPOINT, MANIFEST, PROGRESS, RANK_METRICS, TRACE_EVENT

#: File names of a run's directory (fixed values).
METRICS_FILE, MARKER_FILE, FAILURE_FILE = "metrics-rank*.jsonl", "progress-rank*.json", "failure-rank*.json"
MANIFEST_FILE, ATTEMPT_FILE = "manifest.json", "attempt.json"


def _run(path: str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def rank_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of metric files with their run, the file's directory; malformed rows fail the query.

    The path comes from the file's metadata column, which leaves filters free to reach the scan.
    """
    rows = spark.read.schema(RANK_METRICS).option("mode", "FAILFAST").json(paths)
    return rows.select("*", F.regexp_replace("_metadata.file_path", r"/metrics-rank[^/]*$", "").alias("run"))


def file_ranks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(run, rank) told by the names of metric files, rows or not."""
    names = spark.read.format("binaryFile").load(paths).select("path")
    return names.select(_run("path").alias("run"), F.regexp_extract("path", r"metrics-rank(\d+)[^/]*$", 1).cast("long").alias("rank"))


def rank_set_errors(ranks: DataFrame, worlds: DataFrame) -> DataFrame:
    """(run, missing, unexpected) of runs whose files aren't exactly those of ranks 0 to world - 1."""
    seen = ranks.groupBy("run").agg(F.collect_set("rank").alias("seen"))
    wanted = F.sequence(F.lit(0).cast("long"), F.col("world_size") - 1)
    rows = worlds.join(seen, "run", "left").withColumn("seen", F.coalesce("seen", F.expr("array()").cast("array<bigint>")))
    rows = rows.select("run", F.array_except(wanted, "seen").alias("missing"), F.array_except("seen", wanted).alias("unexpected"))
    return rows.filter((F.size("missing") > 0) | (F.size("unexpected") > 0))


def json_documents(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """One row a JSON document, with its directory as run."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths).select("*", _run("_metadata.file_path").alias("run"))


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_documents(spark, paths, MANIFEST)


def checkpoint_markers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_documents(spark, paths, CHECKPOINT).withColumn("checkpoint", F.element_at(F.split("run", "/"), -1))


def trace_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of trace documents, plain or gzipped, whose root is a list or an object with traceEvents."""
    text = spark.read.text(paths, wholetext=True)
    document = F.parse_json("value")
    events = F.coalesce(F.try_variant_get(document, "$.traceEvents", "array<variant>"), F.try_variant_get(document, "$", "array<variant>"))
    rows = text.select(F.explode(events).alias("e"))
    field = lambda name, kind: F.try_variant_get("e", f"$.{name}", kind)
    return rows.select(*[field(f.name, f.dataType.simpleString()).alias(f.name) for f in TRACE_EVENT.fields if f.name != "args"], F.struct(field("args.device", "bigint").alias("device")).alias("args"))


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc, path, content) of text files, directories searched to the bottom; a file named twice is one document."""
    require(bool(paths), "no documents given")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(paths)
    rows = files.select("path", "content").dropDuplicates(["path"])
    listed = rows.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("_at", F.monotonically_increasing_id())
    listed = listed.withColumn("_part", F.shiftright("_at", 33))
    parts = listed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.shiftleft("_part", 33)).alias("_base"))
    numbered = listed.join(parts, "_part").select("path", (F.col("_at") + F.col("_base")).alias("doc"))
    return rows.join(numbered, "path").select("doc", "path", "content")


def journals(spark: SparkSession, directory: str) -> DataFrame:
    """(run, rank, content, and the marker's fields) of each journal; a rank's marker and data meet by name."""
    data = spark.read.format("binaryFile").load(f"{directory}/metrics-rank*.jsonl").select(_run("path").alias("run"), F.regexp_extract("path", r"metrics-rank(\d+)\.jsonl$", 1).cast("long").alias("rank"), "content")
    markers = json_documents(spark, f"{directory}/{MARKER_FILE}", PROGRESS).withColumn("run", F.regexp_replace("run", "^file:/+", "file:/"))
    return data.withColumn("run", F.regexp_replace("run", "^file:/+", "file:/")).join(markers, ["run", "rank"])
