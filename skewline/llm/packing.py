"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces go in by
falling length; each picks, among the open sequences where it fits under every capacity, the one with the least weighted
norm of what would be left (`rule="norm"`), or the largest weighted dot-product of its demand with what is left
(`rule="dot"`); if none fits, a sequence opens.

Scale: pieces are dealt at random (by a row number salted through a hash) to groups of about `group_docs` documents, so a
hot source or id doesn't meet in one task, and each group is packed by itself; a group wastes at most about one sequence
of some thousand. Only the rows given are shuffled: drop the ids first where a digest is enough.

Defined results: a null text counts as empty and still gives one piece, holding the end id; a null id stays null; repeated
rows are packed one by one; an empty table gives an empty table; ties in length go by row number; other columns of the
input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenization import BATCH_BYTES, SPLIT_BYTES, ChunkEncoder, balanced, encoder, texts_of

CAPACITY = 2048
GROUP_DOCS = 4096
#: Weights of tokens, documents and attention cost in the choice of a sequence: tokens decide, the others break ties.
WEIGHTS = (1.0, 1e-3, 1e-3)


def whole_ids(texts: list[bytes], enc: ChunkEncoder, batch_bytes: int, split_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(text number, its ids) in order. A round's last text may go on in the next round, so it is given once another text begins."""
    done, held = [[] for _ in texts], 0
    for rows, parts in balanced(texts, batch_bytes, split_bytes, enc.by_chunk):
        ids, n = enc.ids(parts)
        raw, ends = ids.tobytes(), np.cumsum(n * 4).tolist()
        for i, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True):
            done[i].append(raw[a:b])
        for i in range(held, rows[-1]):
            yield i, b"".join(done[i])
            done[i] = None
        held = rows[-1]
    if texts:
        yield held, b"".join(done[held])


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = BATCH_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(id, piece int, start long, length long, row_no long, ids binary of little-endian unsigned 32-bit ids).

    Only a document of more than `capacity` tokens is cut, into pieces of `capacity`, the last one shorter. No shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        row_no = TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for batch in batches:
            keys = batch.column(0)
            texts = texts_of(batch.column(1))
            out, size = ([], [], [], [], [], []), 0
            for i, ids in whole_ids(texts, enc, batch_bytes, split_bytes):
                data = ids + end
                for k, at in enumerate(range(0, len(data), step)):
                    piece = data[at : at + step]
                    for column, value in zip(out, (i, k, at // 4, len(piece) // 4, row_no, piece), strict=True):
                        column.append(value)
                    row_no += 1
                    size += len(piece)
                if size >= BATCH_BYTES:
                    yield _piece_batch(keys, out, id_column)
                    out, size = ([], [], [], [], [], []), 0
            if out[0]:
                yield _piece_batch(keys, out, id_column)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(cut, f"`{id_column}` {kind}, piece int, start bigint, length bigint, row_no bigint, ids binary")


def _piece_batch(keys: pa.Array, out: tuple, id_column: str) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *(pa.array(x, t) for x, t in zip(out[1:], kinds, strict=True))], names=[id_column, "piece", "start", "length", "row_no", "ids"])


def vector_best_fit(lengths: np.ndarray, caps: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and token offset of each piece, in the order given. A piece that fits nowhere alone is an error."""
    n = len(lengths)
    demand = np.stack([lengths.astype(float), np.ones(n), lengths.astype(float) ** 2], 1)
    caps_ = np.array(caps, float)
    if n and (demand > caps_).any():
        raise ValueError("a piece exceeds a capacity by itself")
    scaled, weight = demand / caps_, np.array(weights, float)
    smallest = np.minimum.accumulate(scaled[np.argsort(-lengths, kind="stable")][::-1], axis=0)[::-1] if n else scaled
    left, used = np.empty((64, 3)), np.zeros(64, np.int64)
    names = np.empty(64, np.int64)
    live = opened = 0
    bin_of, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    tiny = 1e-12
    for rank, i in enumerate(np.argsort(-lengths, kind="stable").tolist()):
        d = scaled[i]
        rest = left[:live] - d
        fits = rest[:, 0] >= -tiny
        fits &= rest[:, 1] >= -tiny
        fits &= rest[:, 2] >= -tiny
        at = np.flatnonzero(fits)
        if len(at):
            if rule == "norm":
                at = at[np.argmin((rest[at] ** 2) @ weight)]
            else:
                at = at[np.argmax((left[at] * d) @ weight)]
        else:
            if live == len(left):
                left, used, names = np.concatenate([left, left]), np.concatenate([used, used]), np.concatenate([names, names])
            at = live
            left[at], used[at], names[at] = 1.0, 0, opened
            live += 1
            opened += 1
        left[at] -= d
        bin_of[i], offset[i] = names[at], used[at]
        used[at] += lengths[i]
        if (left[at] < (smallest[rank + 1] if rank + 1 < n else 2) - tiny).any():  # nothing to come fits: close it
            live -= 1
            left[at], used[at], names[at] = left[live], used[live], names[live]
    return bin_of, offset


def pack(
    pieces: DataFrame,
    n_docs: int,
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """Add sequence_id long and offset long to rows that have length and row_no (dropped); offsets leave no gap.

    Without `max_documents` or `max_attention` those capacities are what `capacity` tokens can hold at most.
    """
    groups = max(1, math.ceil(n_docs / group_docs))
    caps = (capacity, max_documents or capacity, max_attention or float(capacity) ** 2)
    kept = [f for f in pieces.schema.fields if f.name != "row_no"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no", kind="stable")
        bins, offsets = vector_best_fit(rows["length"].to_numpy(np.int64), caps, weights, rule)
        rows = rows.assign(sequence_id=bins * groups + key[0], offset=offsets)
        return rows[[f.name for f in schema.fields]]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("row_no"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(lambda key, rows: place(key, rows.drop(columns="_group")), schema)
