"""Corpora laid out by sample id whose files are sealed: each by its hash, all by one, and watched while they are read.

`windows/` holds (sample_id, doc, length, tokens) in ranges of ids, `files/` a row a file: what it holds and its hash. Opening
hashes every file again; after that a file that was touched is refused by the scan that reads it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..guards import require
from . import scratch

WINDOWS, FILES, HEADER = "windows", "files", "manifest"
WINDOW = "sample_id long, doc long, length long, tokens binary"
#: A file's rows, few enough that it is hashed as one value: 2**18 windows of 4 KB are 1 GB.
ROWS_PER_FILE = 1 << 18


def lay_out(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write windows in ranges of ids, each range sorted, so that an id lies in one file and files follow one another."""
    parts = max(1, -(-rows.count() // rows_per_file))
    ranged = rows.repartitionByRange(parts, "sample_id").sortWithinPartitions("sample_id")
    ranged.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{WINDOWS}")


def base_name(path: str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, sha256) of the window files as they are now; a task hashes a file at a time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{WINDOWS}")
    return found.select(base_name("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def seal(spark: SparkSession, path: str) -> str:
    """Write `files/` for the windows under `path`; the hash over it. Only files that hold windows count."""
    rows = spark.read.schema(WINDOW).parquet(f"{path}/{WINDOWS}")
    held = rows.groupBy(base_name("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"), F.sum("length").alias("tokens"))
    hashed(spark, path).drop("modified").join(held, "file").write.mode("errorifexists").parquet(f"{path}/{FILES}")
    return files_sha256(spark.read.parquet(f"{path}/{FILES}"))


def files_sha256(files: DataFrame) -> str:
    """One hash of the table of files: of 4,096 groups of files first, so that no value holds the hashes of all."""
    line = F.sha2(F.to_json(F.struct(*[F.col(c) for c in ("file", "bytes", "sha256", "rows", "first_id", "last_id", "tokens")])).cast("binary"), 256).alias("h")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    parts = files.select(line).groupBy(F.substring("h", 1, 3)).agg(joined("h").alias("part"))
    return parts.agg(joined("part")).first()[0]


def content_sha256(manifest: dict) -> str:
    told = {k: v for k, v in manifest.items() if k != "sha256"}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def changes(files: DataFrame, now: DataFrame) -> DataFrame:
    """(file, reason) of files that are not as they were sealed."""
    a, b = files.select("file", F.struct("bytes", "sha256").alias("a")), now.select("file", F.struct("bytes", "sha256").alias("b"))
    both = a.join(b, "file", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    reason = F.when(F.col("a").isNull(), "not sealed").when(F.col("b").isNull(), "missing").when(F.col("a.bytes") != F.col("b.bytes"), "size").otherwise("content")
    return both.select("file", reason.alias("reason"))


def extent_errors(files: DataFrame) -> DataFrame:
    """(file, reason) of files whose ids have gaps or don't follow the file before. A row a file, so one window over all is small."""
    before = F.coalesce(F.lag("last_id").over(Window.orderBy("first_id")), F.lit(-1).cast("long"))
    rows = files.withColumn("_before", before)
    reason = F.when(F.col("first_id") != F.col("_before") + 1, "ids don't follow").when(F.col("rows") != F.col("last_id") - F.col("first_id") + 1, "ids have gaps")
    return rows.select("file", reason.alias("reason")).filter("reason IS NOT NULL")


class SealedCorpus:
    """A corpus that was whole when it was opened, and refuses what has changed since.

    Opening checks the manifest's own hash, the hash over the table of files, every file's bytes and hash, that no other file
    is there, that ids are 0 to the number of windows without gaps, and the sums of windows and targets.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = json.loads(spark.read.text(f"{path}/{HEADER}").first()[0])
        require(self.manifest.get("schema_version") == 1 and self.manifest.get("sha256") == content_sha256(self.manifest), "the corpus's manifest changed")
        sealed = spark.read.parquet(f"{path}/{FILES}")
        require(files_sha256(sealed) == self.manifest["files_sha256"], "the corpus's table of files changed")
        now = scratch.stored(hashed(spark, path), "opened")
        bad = changes(sealed, now).first() or extent_errors(sealed).first()
        require(bad is None, f"the corpus's files changed: {bad}")
        total = sealed.agg(F.sum("rows"), F.sum(F.col("tokens") - F.col("rows"))).first()
        require(tuple(total) == (self.manifest["samples"], self.manifest["valid_tokens"]), "the corpus's windows don't add up")
        self.files = sealed.join(now.select("file", "modified"), "file")

    def __len__(self) -> int:
        return self.manifest["samples"]

    def _scan(self, files: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Rows of the windows; one of a file that isn't as it was on opening fails the scan that reads it."""
        where = [f"{self.path}/{WINDOWS}/{n}" for n in names] if names else [f"{self.path}/{WINDOWS}"]
        meta = F.struct(base_name("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))
        rows = self.spark.read.schema(WINDOW).parquet(*where).select("*", meta.alias("_now"))
        known = files.select(F.col("file").alias("_file"), F.struct("file", "bytes", "modified").alias("_opened"))
        same = F.col("_now").eqNullSafe(F.col("_opened"))
        failed = F.raise_error(F.concat(F.lit("the corpus changed while open: "), F.col("_now.file")))
        return rows.join(known, F.col("_now.file") == F.col("_file"), "left").filter(F.when(same, F.lit(True)).otherwise(failed)).select("sample_id", "doc", "length", "tokens")

    def rows(self) -> DataFrame:
        """All windows. A file that has gone since opening is told at once, one that was touched by the scan."""
        there = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{WINDOWS}").select(base_name("path").alias("file"))
        gone = self.files.join(there, "file", "left_anti").first()
        require(gone is None, f"the corpus changed while open: {gone}")
        return self._scan(self.files)

    def sample(self, sample_id: int) -> DataFrame:
        """One window, read from the one file that holds its id."""
        if isinstance(sample_id, bool) or not isinstance(sample_id, int) or not 0 <= sample_id < len(self):
            raise IndexError(sample_id)
        holder = self.files.filter((F.col("first_id") <= sample_id) & (F.col("last_id") >= sample_id))
        return self._scan(holder, [holder.first()["file"]]).filter(F.col("sample_id") == sample_id)
