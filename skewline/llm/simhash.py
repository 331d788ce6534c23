"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts; within a pair of tiles they are ordered by population
count, and blocks whose population counts differ by more than the radius are skipped, since so many bits differ at least; whole
pairs of tiles are all dealt. Buckets make the comparison scale without losing a link: the 64 bits are cut into m parts, and two
fingerprints within `radius` bits agree on at least m - radius parts whole, so comparing those that agree on some
m - radius parts finds every link. m, and with it the number of buckets, follows the number of distinct fingerprints.

Exact copies share a fingerprint and are compared once. A bucket is cut into tiles of `TILE`; each pair of tiles is a task
unit of its own, so a large bucket is spread. A pair of tiles gives a spanning forest of its links, at most one row a
fingerprint; components come from these by alternating star contraction with checkpoints; nothing is collected.

Defined results: a null text counts as empty; no word: fingerprint zero, linked like any other; a null id takes no part in
the smallest id, and gets its component's id (null if no member has one); repeated rows keep a row each; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokenization import texts_of

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in a tile.
TILE = 1024
#: Buckets are made so small that about so many fingerprints share one, if bits were even.
BUCKET = 256


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        a, b = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    else:
        a, b = [0], [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[x:y], seed) for x, y in zip(a, b, strict=True)), "<u8", len(a))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        some = hashes[lo : lo + 65536]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f long): the fingerprint's 64 bits as a signed number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t) for t in texts_of(batch.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.int64())], names=["doc_id", "f"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(compute, f"doc_id {kind}, f bigint")


def parts_for(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(m, k): the number of parts, and of parts that a bucket's members agree on."""
    m = radius + 1
    while m < 4 * radius and n > BUCKET << (64 * (m - radius) // m):
        m += 1
    return m, m - radius


def bucket_keys(m: int, k: int) -> list[list[tuple[int, int]]]:
    """For each choice of k of the m parts, the (shift, mask) of its parts."""
    edges = [64 * i // m for i in range(m + 1)]
    parts = [(edges[i], (1 << (edges[i + 1] - edges[i])) - 1) for i in range(m)]
    return [list(c) for c in itertools.combinations(parts, k)]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs of two tiles (or within one), each ordered by population count; blocks too far apart in it are skipped."""
    same = b is None
    other = a if same else b
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(other).astype(np.int16)
    left, right = [], []
    step = 256
    for lo in range(0, len(a), step):
        hi = min(lo + step, len(a))
        from_ = max(np.searchsorted(pb, pa_[lo] - radius), lo if same else 0)
        to = np.searchsorted(pb, pa_[hi - 1] + radius, side="right")
        if from_ >= to:
            continue
        i, j = np.nonzero(np.bitwise_count(a[lo:hi, None] ^ other[None, from_:to]) <= radius)
        i, j = i + lo, j + from_
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): enough links of distinct fingerprints f to span every component."""
    m, k = parts_for(n, radius)
    bits = lambda shift, mask: F.shiftrightunsigned("f", shift).bitwiseAND(F.lit(mask))
    keys = [F.xxhash64(F.lit(c), *[bits(s, mask) for s, mask in parts]) for c, parts in enumerate(bucket_keys(m, k))]
    rows = distinct.select("f", F.explode(F.array(*keys)).alias("bucket"))
    # A member of tile t of T goes to the T pairs (t, *); a bucket of up to one tile is one pair. Few buckets are larger, so
    # the join is a broadcast while their table is small, and else a skew join on freshly dealt sides.
    large = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile))
    rows = rows.join(large, "bucket", "left")
    tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1).cast("long"))
    rows = rows.withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("f", "bucket"), F.col("tiles"))).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("f", "t", F.xxhash64("bucket", F.least("t", "u"), F.greatest("t", "u")).alias("pair"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair; a pair is compared when its last row is there."""
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            if not last:
                held.append(np.stack([batch.column(c).to_numpy() for c in ("pair", "t", "f")]))
            if not held or (not last and sum(x.shape[1] for x in held) < 1 << 16):
                continue
            rows = np.concatenate(held, axis=1)
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            end = rows.shape[1] if last else (int(cuts[-1]) if len(cuts) else 0)
            out_a, out_b = [], []
            for lo, hi in zip([0, *cuts[cuts < end]], [*cuts[cuts < end], end], strict=True):
                if hi - lo < 2:
                    continue
                t, f = rows[1, lo:hi], rows[2, lo:hi].view(np.uint64)
                order = np.lexsort((f, np.bitwise_count(f), t))
                t, f = t[order], f[order]
                two = int(np.searchsorted(t, t[0], side="right"))
                if two < len(f) and t[two] != t[-1]:  # two pairs of one hash: compare all with all
                    f, two = f[np.argsort(np.bitwise_count(f), kind="stable")], len(f)
                i, j = tile_links(f, None, radius) if two == len(f) else tile_links(f[:two], f[two:], radius)
                if not len(i):
                    continue
                if two < len(f):
                    j = j + two
                label = forest(len(f), i, j)
                moved = np.flatnonzero(label != np.arange(len(f)))
                out_a.append(f[moved].view(np.int64))
                out_b.append(f[label[moved]].view(np.int64))
            held = [rows[:, end:]] if end < rows.shape[1] else []
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(f, root): for each fingerprint with a link, the smallest of its component, by alternating large-star and small-star."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        # The tables of minima are written so that both sides of each join are dealt anew: then a hub's rows can be split.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = written(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        low = written(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(low, "u")
        edges = written(joined.select("v", "m").union(joined.select("u", "m")).toDF("u", "v").filter("u != v").distinct())
        hashes = F.xxhash64("u", "v").cast("decimal(38,0)")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(hashes)).first())
        if state == before:
            return edges.select(F.col("u").alias("f"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint string, component_id): the smallest id reachable over links of at most `radius` bits."""
    prints = written(fingerprints(docs, id_column, text_column))
    distinct = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    roots = components(links(distinct, n, radius))
    joined = written(distinct.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root")))
    ids = written(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = written(joined.join(ids, "root").select("f", "component_id"))
    return prints.join(classes, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of `docs` with one of each group of near-duplicates: the smallest (doc_id, hash of the text), nulls last.

    Rows that are alike in both are one. Ids and fingerprints decide; the texts are dealt once, by (doc_id, hash), to meet
    the short list of rows to keep.
    """
    names = docs.columns
    rows = docs.withColumn("__dedup_hash", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    keyed = rows.select(F.struct("doc_id", "__dedup_hash").alias("__dedup_key"), "text")
    prints = written(fingerprints(keyed, "__dedup_key").select("doc_id.doc_id", "doc_id.__dedup_hash", "f"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__dedup_hash")
    distinct = written(prints.groupBy("f").agg(F.min(order).alias("least")))
    roots = components(links(distinct, distinct.count(), radius))
    keep = distinct.join(roots, "f", "left").groupBy(F.coalesce("root", "f").alias("root")).agg(F.min("least").alias("least"))
    keep = written(keep.select(F.col("least.doc_id").alias("__dedup_id"), F.col("least.__dedup_hash").alias("__dedup_hash_kept")))
    same = rows["doc_id"].eqNullSafe(F.col("__dedup_id")) & (rows["__dedup_hash"] == F.col("__dedup_hash_kept"))
    return rows.join(keep, same).dropDuplicates(["doc_id", "__dedup_hash"]).select(*names)
