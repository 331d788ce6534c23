"""Periodic run detection: an all-lag vectorised scan over word ids, with ranges of lags of long documents dealt to machines.

A run is a stretch of consecutive words with smallest period q, at least `min_words` and `min_exponent` * q long, that no
neighbouring word extends keeping the period. At lag q such a run is a stretch of at least max(min_words - q, (min_exponent -
1) * q) places where a word equals the one q further on, so every lag up to n / min_exponent is compared; a stretch of that
length can't pass between places a quarter of it apart, so only those are looked at first, and all places around them where
four or so in a row agree. The scan costs about 8 n ln n comparisons for a document of n words, not n^2.

The documents of a batch are scanned as one array, longest first, each closed by a number of its own: at lag q only the front
of the array, whose documents have the words for it, is read, and no stretch that is long enough can cross a closing number.
A stretch with lag q may have a smaller period, which then divides q and gives the same stretch; it is told from the first q
words, so what a lag finds needs no other lag, and lag ranges can be scanned anywhere in any order.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; a null id
stays null; repeated rows give a row each; an empty table gives an empty table; other columns of the input are not looked at,
whatever their names. Texts of over `long_bytes` bytes, however long, are scanned as several rows of lag ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

MIN_WORDS = 24
MIN_EXPONENT = 3
BATCH_BYTES = 8 << 20
#: Texts beyond this are scanned as ranges of so many lags.
LONG_BYTES = 4 << 20
LAGS = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, end to end, and each text's number of words."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    kept = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False))))
    return flat.filter(kept), np.diff(upto[offsets - offsets[0]])


def smallest_period(ids: np.ndarray, start: int, period: int) -> int:
    """Of a run that has `period` and holds it at least twice: the smallest one divides it."""
    rest, p = period, 2
    while rest > 1:
        p = p if p * p <= rest else rest
        if rest % p:
            p += 1
            continue
        rest //= p
        while period % p == 0:
            d = period // p
            if not np.array_equal(ids[start : start + period - d], ids[start + d : start + period]):
                break
            period = d
        while rest % p == 0:
            rest //= p
    return period


def scan(ids: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, first: int = 1, last: int | None = None) -> list[tuple[int, int, int]]:
    """(place, length, period) of the runs that lags from `first` to before `last` show, in an array of documents.

    `sizes`: words of the documents, descending; each is followed in `ids` by a number that occurs nowhere else.
    """
    found: dict[tuple[int, int], int] = {}
    over: np.ndarray | None = None  # the run found last at each place
    runs: list[tuple[int, int, int]] = []
    ends = np.concatenate(([0], np.cumsum(sizes + 1)))
    longest = int(sizes[0]) if len(sizes) else 0
    for q in range(first, min(last or longest, longest // min_exponent) + 1):
        if last is not None and q >= last:
            break
        least = max(min_words - q, (min_exponent - 1) * q, 1)
        top = int(ends[np.searchsorted(-sizes, -max(min_words, min_exponent * q), side="right")]) - q
        if top <= 0:
            break
        step = max(1, least // 4)
        need = least // step
        at = np.flatnonzero(ids[0:top:step] == ids[q : top + q : step])
        if len(at) < need or not (at[need - 1 :] - at[: len(at) - need + 1] == need - 1).any():
            continue
        cuts = np.flatnonzero(np.diff(at) != 1)
        lows, highs = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))]
        long = highs - lows >= need - 1
        for low, high in zip((lows[long] * step).tolist(), (highs[long] * step).tolist(), strict=True):
            if over is not None and (k := over[low]) >= 0:
                s, n, p = runs[k]
                if q % p == 0 and s <= low and high < s + n - q:
                    continue  # the same stretch again, at a multiple of its period
            lo, hi = max(low - step + 1, 0), min(high + step, top)
            breaks = np.concatenate(([-1], np.flatnonzero(ids[lo:hi] != ids[lo + q : hi + q]), [hi - lo]))
            gaps = np.diff(breaks) - 1
            for i in np.flatnonzero(gaps >= least).tolist():
                s, n = lo + int(breaks[i]) + 1, int(gaps[i]) + q
                if (s, n) not in found:
                    found[s, n] = p = smallest_period(ids, s, q)
                    if over is None:
                        over = np.full(len(ids), -1, np.int32)
                    over[s : s + n] = len(runs)
                    runs.append((s, n, p))
    return runs


def scan_texts(texts: pa.Array, min_words: int, min_exponent: int, first: int = 1, last: int | None = None) -> tuple[pa.Array, np.ndarray, list[list[tuple[int, int, int]]]]:
    """The words of the texts, each text's number of words, and each text's runs by start, then period."""
    flat, counts = words_of(texts)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int32)
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(len(codes) + len(counts), np.int32)
    ids[starts + sizes] = -1 - np.arange(len(counts))
    own = np.cumsum(counts) - counts
    n = int(sizes.sum())
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
    ids[places] = codes[np.repeat(own[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(counts))]
    for s, length, p in scan(ids, sizes, min_words, min_exponent, first, last):
        d = int(np.searchsorted(starts, s, side="right")) - 1
        runs[order[d]].append((s - int(starts[d]), length, p))
    for x in runs:
        x.sort(key=lambda r: (r[0], r[2]))
    return flat, counts, runs


def collapsed(flat: pa.Array, counts: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Each text's words joined by one space, without those that a run contains after its first period."""
    kept = np.ones(len(flat), bool)
    first = np.cumsum(counts) - counts
    for at, some in zip(first.tolist(), runs, strict=True):
        for s, n, p in some:
            kept[at + s + p : at + s + n] = False
    upto = np.concatenate(([0], np.cumsum(kept)))
    offsets = upto[np.concatenate((first, [len(flat)]))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(kept))), " ")


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; the text is the second column."""
    if not len(batch):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part, lo = size // most, 0
    for hi in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]:
        yield batch.slice(lo, hi - lo)
        lo = hi


def _runs_array(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for x in runs for r in x]
    columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in runs], dtype=np.int64))), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str | Column = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
    batch_bytes: int = BATCH_BYTES,
    long_bytes: int = LONG_BYTES,
    lags: int = LAGS,
) -> DataFrame:
    """(id, runs array of (start, length, period) by start, then period; collapsed string) of each row's text.

    Texts of up to `long_bytes` are scanned where they are read, without a shuffle. A longer one becomes a row for every
    `lags` lags it may have; the runs found meet again by the text's hash, at most one list a text, and so with its rows.
    """
    if min_exponent < 2 or min_words < 1:
        raise ValueError("runs hold their period at least twice, and a word")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), text_or_empty(text_column).alias("_text"))
    size = F.octet_length("_text")
    short, long = rows.filter(size <= long_bytes), rows.filter(size > long_bytes).withColumn("_key", F.sha2("_text", 256))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, batch_bytes):
                flat, counts, runs = scan_texts(part.column(1), min_words, min_exponent)
                yield pa.RecordBatch.from_arrays([part.column(0), _runs_array(runs), collapsed(flat, counts, runs)], names=["_id", "runs", "collapsed"])

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                first = row.column(2)[0].as_py() * lags + 1
                runs = scan_texts(row.column(1), min_words, min_exponent, first, first + lags)[2][0]
                columns = [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([row.column(0)[0].as_py()] * len(runs), pa.string()), *columns], names=["_key", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                flat, counts = words_of(row.column(1))
                runs = [[(r["start"], r["length"], r["period"]) for r in row.column(2)[0].as_py() or ()]]
                yield pa.RecordBatch.from_arrays([row.column(0), _runs_array(runs), collapsed(flat, counts, runs)], names=["_id", "runs", "collapsed"])

    schema = f"_id {kind}, runs {RUNS}, collapsed string"
    # A text of b bytes has at most (b + 1) / 2 words.
    most = F.floor((F.octet_length("_text") + 1) / (2 * min_exponent) / lags)
    ranges = long.dropDuplicates(["_key"]).select("_key", "_text", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("_range"))
    found = ranges.repartition("_key", "_range").mapInArrow(of_range, "_key string, start bigint, length bigint, period bigint").distinct()
    lists = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    lists = lists.select("_key", F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("_runs"))
    far = long.join(lists, "_key", "left").select("_id", "_text", "_runs").mapInArrow(joined, schema)
    return short.mapInArrow(whole, schema).unionByName(far).withColumnRenamed("_id", id_column)


def best_run(runs: Column) -> Column:
    """The run of the greatest length / period, the first of them in the order of `runs`; null if there is none."""
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), more)


def repeated_tail(text: Column, start: Column, period: Column) -> Column:
    """`text` with every word from number `start` on replaced by those of the `period` words there, in turn; words joined by a space."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"), start.alias("start"), period.alias("period"))
    at = lambda w, i: F.when(i < w["start"], i).otherwise(w["start"] + (i - w["start"]) % w["period"])
    of = lambda w: F.array_join(F.transform(w["words"], lambda _, i: F.element_at(w["words"], (at(w, i) + 1).cast("int"))), " ")
    return F.transform(F.array(whole), of)[0]  # a variable, so that words are found once and not at every word
