"""Byte-window corpora: segmentation in closed form, accounting, offsets, content identity, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..guards import Rules, require

MAX_LENGTH = 128
MIN_LENGTH = 2


def window_counts(n: Column | str, max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH) -> tuple[Column, Column, Column]:
    """(full windows, bytes of the tail, whether the tail is kept) of a document of n bytes.

    Windows advance by one byte less than their length, so each starts with the last byte of the one before, and every
    byte but a document's first is a target once.
    """
    require(min_length >= 2 and max_length >= min_length, "window lengths need 2 <= min <= max")
    n = F.col(n) if isinstance(n, str) else n
    full = F.when(n < max_length, F.lit(0)).otherwise(F.floor((n - 1) / (max_length - 1))).cast("long")
    tail = n - full * (max_length - 1)
    return full, tail, tail >= min_length


def windows(docs: DataFrame, max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH, id_column: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc, piece, length, tokens binary); windows never cross documents. Narrow: no shuffle."""
    full, tail, kept = window_counts(F.octet_length(content), max_length, min_length)
    count = full + F.when(kept, 1).otherwise(0)
    rows = docs.select(F.col(id_column).alias("doc"), F.col(content).alias("_content"), F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).alias("_pieces"))
    rows = rows.select("doc", "_content", F.explode("_pieces").alias("piece"))
    tokens = F.substring(F.col("_content"), (F.col("piece") * (max_length - 1) + 1).cast("int"), F.lit(max_length))
    return rows.select("doc", "piece", tokens.alias("tokens")).select("doc", "piece", F.octet_length("tokens").cast("long").alias("length"), "tokens")


def accounting(docs: DataFrame, max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH, id_column: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc, bytes, samples, valid_tokens, dropped_targets, sha256): closed form, no window is made."""
    n = F.octet_length(content).cast("long")
    full, tail, kept = window_counts(n, max_length, min_length)
    kept_one = F.when(kept, 1).otherwise(0)
    return docs.select(
        F.col(id_column).alias("doc"),
        n.alias("bytes"),
        (full + kept_one).cast("long").alias("samples"),
        (full * (max_length - 1) + F.when(kept, tail - 1).otherwise(0)).cast("long").alias("valid_tokens"),
        F.when(kept, F.lit(0)).otherwise(F.greatest(F.lit(0), tail - 1)).cast("long").alias("dropped_targets"),
        F.sha2(F.col(content), 256).alias("sha256"),
    )


def totals(accounts: DataFrame) -> DataFrame:
    return accounts.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("bytes", "samples", "valid_tokens", "dropped_targets")])


def offsets(sizes: DataFrame, id_column: str = "doc", size: str = "length", buckets: int = 1024) -> DataFrame:
    """Adds `offset`, the sum of sizes before a row in order of `id_column`, without one task for all rows.

    Ids are cut into ranges; ranges are summed in a table of at most `buckets` rows, then each range sums for itself.
    """
    bounds = sizes.agg(F.min(id_column).alias("lo"), F.max(id_column).alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / buckets), F.lit(1))
    rows = sizes.join(F.broadcast(bounds)).withColumn("_range", F.floor((F.col(id_column) - F.col("lo")) / width)).drop("lo", "hi")
    sums = rows.groupBy("_range").agg(F.sum(size).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(id_column).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(base), "_range").withColumn("offset", F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    return rows.drop("_range", "_base")


def utf8_rules(content: str = "content") -> Rules:
    return {"not UTF-8": ~F.is_valid_utf8(F.col(content).cast("string"))}


def identity(accounts: DataFrame) -> DataFrame:
    """One hash of the documents' hashes in id order, found by ranges first so that the last step is a short list."""
    lines = F.array_sort(F.collect_list(F.struct("doc", "sha256")))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x["doc"].cast("string"), F.lit(":"), x["sha256"], F.lit("\n"))), "")
    parts = accounts.groupBy(F.floor(F.col("doc") / 1000).alias("part")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))
    whole = F.array_sort(F.collect_list(F.struct("part", "h")))
    return parts.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["h"]), "").cast("binary"), 256).alias("corpus_sha256"))


def index_rules(min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, documents: int | None = None) -> Rules:
    """Bad rows of a stored index (sample_id, doc, offset, length, expected_offset)."""
    rules = {"offset": F.col("offset") != F.col("expected_offset"), "length": (F.col("length") < min_length) | (F.col("length") > max_length), "document": F.col("doc") < 0}
    if documents is not None:
        rules["document"] = (F.col("doc") < 0) | (F.col("doc") >= documents)
    return rules


def verify_index(index: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, documents: int | None = None) -> DataFrame:
    """Violations of contiguous offsets, length and document bounds."""
    from ..guards import violations

    expected = offsets(index.withColumnRenamed("offset", "_stored"), "sample_id", "length").withColumnRenamed("offset", "expected_offset").withColumnRenamed("_stored", "offset")
    return violations(expected, index_rules(min_length, max_length, documents))


def sample(corpus: DataFrame, sample_id: int) -> DataFrame:
    """Random access: a pushed-down filter on the id."""
    return corpus.filter(F.col("sample_id") == sample_id)
