"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights gives a document's score s, and ordered thresholds t_1 < t_2 turn it into
P(grade <= k) = logistic(t_k - s); from these come the expected grade and the tail probability P(grade >= 2) that selects.
Grades follow the labels: 0 for low quality, 1 for fair text that is toxic, 2 for clean.

A text's features are shares of its words (each word's lower-case stem without outer marks, stems' beginnings, its shape of
case and trailing marks, and whether it repeats the word before) and how many distinct words it has of a stem or beginning,
whatever its length. Features count in full where the sample shows them to tell grades apart beyond doubt, less the less clear
that is, and not at all below `MIN_Z` standard errors: so a long text doesn't drift by many words of no meaning. Both add up over words, so a word's weights are
looked up once and remembered by the Python worker in a bounded cache. Fitted by adaptive gradient steps on at most `SAMPLE` labelled
documents (those of smallest hash, so reruns agree); all documents are scored over their whole text.

Defined results: a null or wordless text has score 0; without labels of at least two grades all documents have the tail
probability 1; a null id stays null; repeated rows get a row each; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .quality_rules import labelled_sample
from .tokenization import texts_of

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 8192
HASH_BITS = 19
#: Least P(top grade) of what is kept: an unclear document goes.
CUT = 0.8
TOP_GRADE = 2
CACHE_WORDS = 300_000
#: Scale of the shares, so that rare but telling words move the score within a few steps.
SCALE = 20.0
#: Gradient steps at least, however small the sample.
MIN_STEPS = 4000
#: Standard errors between grades from which a feature is used, and from which it is used in full; between, by their power.
MIN_Z = 3.5
FULL_Z = 14.0
Z_POWER = 4
#: Documents of a slot, at least, for it to be used.
LEAST_DOCS = 4
#: Documents whose features a task holds at a time.
ROWS = 256
#: Lengths of the beginnings of stems, in bytes.
BEGINNINGS = (4, 5, 6, 7)
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_REPEAT = 0


def _slot(kind: bytes, key: bytes) -> int:
    return 1 + xxhash.xxh64_intdigest(kind + key, 7) % ((1 << HASH_BITS) - 1)


def word_slots(word: bytes) -> tuple[list[int], list[int]]:
    """Hashed features of a word, by share and by presence; slot 0 is kept for repeats."""
    stem = word.lower().strip(_MARKS)
    tail = word[len(word.rstrip(_MARKS)) :]
    shape = b"U" if word.isupper() and len(stem) > 1 else b"T" if word[:1].isupper() else b"l"
    share = [_slot(b"s", shape + tail[:3])]
    if not stem:
        return share, []
    beginnings = [_slot(b"%d" % k, stem[:k]) for k in BEGINNINGS if k == BEGINNINGS[0] or len(stem) >= k]
    return share + [_slot(b"w", stem), _slot(b"P", stem[:4])], [_slot(b"W", stem), *beginnings]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; presences count distinct words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    slots, values = [], []
    for w, n in Counter(words).items():
        share, presence = word_slots(w)
        slots += share + presence
        values += [n * SCALE / len(words)] * len(share) + [1.0] * len(presence)
    same = sum(map(bytes.__eq__, words, words[1:]))
    slots.append(_REPEAT)
    values.append(same * SCALE / len(words))
    at, where = np.unique(np.array(slots, np.int64), return_inverse=True)
    return at, np.bincount(where, np.array(values), len(at))


def telling(slots: np.ndarray, grade: np.ndarray, grades: np.ndarray, top: int) -> np.ndarray:
    """How far each slot is used, from 0 to 1; `grade` is that of each feature's document."""
    return usefulness([np.bincount(slots[grade == g], minlength=1 << HASH_BITS) for g in range(top + 1)], [int((grades == g).sum()) for g in range(top + 1)])


def usefulness(counts: list[np.ndarray], docs: list[int]) -> np.ndarray:
    """How far each slot is used, from 0 to 1: by the most standard errors by which its document frequencies differ between two
    neighbouring grades, or between the documents on either side of a threshold. `counts` and `docs` are by grade.
    """
    top = len(docs) - 1
    most = np.zeros(1 << HASH_BITS)
    sides = [(range(k), range(k, top + 1)) for k in range(1, top + 1)] + [((k - 1,), (k,)) for k in range(1, top + 1)]
    for low, high in sides:
        a, b = sum(counts[g] for g in high), sum(counts[g] for g in low)
        n, m = max(1, sum(docs[g] for g in high)), max(1, sum(docs[g] for g in low))
        p = (a + b + 1) / (n + m + 2)
        z = (a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
        most = np.maximum(most, np.abs(z) * (a + b >= LEAST_DOCS))
    return np.where(most >= MIN_Z, np.minimum(1, (most / FULL_Z) ** Z_POWER), 0)


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def known(self) -> dict[int, float]:
        """The weights that aren't zero, which are few, by slot."""
        if "_known" not in self.__dict__:
            at = np.flatnonzero(self.weights)
            self._known = dict(zip(at.tolist(), self.weights[at].tolist(), strict=True))
        return self._known

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit_ordinal(slots: np.ndarray, values: np.ndarray, sizes: np.ndarray, grades: np.ndarray, rows: np.ndarray | None = None, top: int = TOP_GRADE, epochs: int = 16, batch: int = 64, rate: float = 0.3, ridge: float = 1e-6, seed: int = 5, use: np.ndarray | None = None) -> Ordinal:
    """Maximum likelihood by adaptive gradient steps; thresholds are a first one and positive gaps, so they stay ordered.

    `slots` and `values` hold the documents' features end to end, `sizes` of them each; `rows` is the order to learn in.
    `use`: how far slots are used, where that is known already.
    """
    weights, squares = np.zeros(1 << HASH_BITS), np.full(1 << HASH_BITS, 1e-8)
    if len(set(grades.tolist())) < 2:
        return Ordinal(weights, np.full(top, -60.0))
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(top) * 1e-3)
    free, free_squares = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))]), np.full(top, 1e-8)
    random = np.random.default_rng(seed)
    use = telling(slots, np.repeat(grades.astype(np.int8), sizes), grades, top) if use is None else use.copy()
    use[_REPEAT] = 1
    kept = use[slots] > 0
    sizes = np.bincount(np.repeat(np.arange(len(grades), dtype=np.int32), sizes)[kept], minlength=len(grades))
    slots = slots[kept]
    values = values[kept] * use[slots].astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for _ in range(max(epochs, -(-MIN_STEPS * batch // len(grades)))):
        order = random.permutation(len(grades)) if rows is None else rows[random.permutation(len(grades))]
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
            owner = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            score = np.bincount(owner, weights[slots[pick]] * values[pick], len(some))
            cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
            edge = np.concatenate([np.zeros((len(some), 1)), below, np.ones((len(some), 1))], 1)
            slope = edge * (1 - edge)
            g, row = grades[some], np.arange(len(some))
            p = np.maximum(edge[row, g + 1] - edge[row, g], 1e-9)
            up, down = slope[row, g + 1] / p, slope[row, g] / p
            d_score = (up - down) / len(some)
            d_cuts = np.zeros(top)
            np.add.at(d_cuts, np.minimum(g, top - 1), np.where(g < top, -up, 0) / len(some))
            np.add.at(d_cuts, np.maximum(g - 1, 0), np.where(g > 0, down, 0) / len(some))
            d_free = np.concatenate([[d_cuts.sum()], np.exp(free[1:]) * np.cumsum(d_cuts[::-1])[::-1][1:]])
            free_squares += d_free**2
            free -= 0.05 * d_free / np.sqrt(free_squares)
            at, where = np.unique(slots[pick], return_inverse=True)
            d = np.bincount(where, d_score[owner] * values[pick], len(at)) + ridge * weights[at]
            squares[at] += d * d
            weights[at] -= rate * d / np.sqrt(squares[at])
    cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    return Ordinal((weights * use).astype(np.float32), cuts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Features of the bounded sample are worked out and counted by the executors, and a task learns from those that tell grades apart; the driver gets weights."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    chosen = labelled_sample(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(chosen.select("doc_id", grade.alias("grade"), "text").mapInArrow(_featured, f"doc_id {kind}, grade int, key long, slots binary, shares binary"))
    docs_of = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(docs_of) < 2:
        dropped(rows)
        return fit_ordinal(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = [f"n{g}" for g in range(TOP_GRADE + 1)]
    counts = rows.select("grade", "slots").mapInArrow(_frequencies, "slot int, " + ", ".join(f"{n} long" for n in names))
    counts = counts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).filter(F.expr(" + ".join(names)) >= LEAST_DOCS).toArrow()
    frequencies = np.zeros((len(names), 1 << HASH_BITS), np.int64)
    for g, n in enumerate(names):
        frequencies[g, counts.column("slot").to_numpy()] = counts.column(n).to_numpy()
    use = usefulness(list(frequencies), [docs_of.get(g, 0) for g in range(TOP_GRADE + 1)])
    use[_REPEAT] = 1
    del counts, frequencies
    used = np.packbits(use > 0)

    def telling_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(used).astype(bool)
        for batch in batches:
            slots = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(3)]
            shares = [np.frombuffer(x.as_buffer(), "<f4") for x in batch.column(4)]
            kept = [some[x] for x in slots]
            both = [pa.array([v[k].tobytes() for v, k in zip(a, kept, strict=True)], pa.binary()) for a in (slots, shares)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *both], names=batch.schema.names)

    at = np.flatnonzero(use)
    how_far = use[at]

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(batches)
        whole = np.zeros(1 << HASH_BITS)
        whole[at] = how_far
        model = _fitted(data, whole)
        slots = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([slots, -1 - np.arange(len(model.cuts))])), pa.array(np.concatenate([model.weights[slots].astype(float), model.cuts]))], names=["slot", "value"])

    told = rows.mapInArrow(telling_ones, rows.schema).repartition(1).mapInArrow(learned, "slot long, value double").toArrow()
    dropped(rows)
    slots, values = told.column("slot").to_numpy(), told.column("value").to_numpy()
    weights, cuts = np.zeros(1 << HASH_BITS, np.float32), np.zeros(TOP_GRADE)
    weights[slots[slots >= 0]] = values[slots >= 0]
    cuts[-1 - slots[slots < 0]] = values[slots < 0]
    return Ordinal(weights, cuts)


def _fitted(data: pa.Table, use: np.ndarray) -> Ordinal:
    grades = data.column("grade").to_numpy().astype(np.int64)
    # The features stay where Arrow has them; only the rows' order is sorted, for the same steps on every run.
    key = pa.array(data.column("key").to_numpy().view(np.uint64))
    order = pc.sort_indices(pa.table([data.column("doc_id"), data.column("grade"), key], names=["a", "b", "c"]), [("a", "ascending"), ("b", "ascending"), ("c", "ascending")]).to_numpy()
    sizes = pc.binary_length(data.column("slots")).to_numpy().astype(np.int64) // 4
    flat = lambda name, kind: np.concatenate([np.frombuffer(c.buffers()[2], kind)[int(_starts(c)[0]) // 4 : int(_starts(c)[-1]) // 4] for c in data.column(name).chunks if len(c) and c.buffers()[2]] or [np.zeros(0, kind)])
    slots, values = flat("slots", "<i4"), flat("shares", "<f4")
    return fit_ordinal(slots, values, sizes, grades, order, use=use)


def _starts(chunk: pa.Array) -> np.ndarray:
    """Offsets of a binary array's values, the last one's end included."""
    return np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and values of each text as bytes, and a hash of the slots."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            slots, shares = [], []
            for s, v in map(features, texts_of(batch.column(2))):
                slots.append(s.astype("<i4").tobytes())
                shares.append(v.astype("<f4").tobytes())
            key = np.array([xxhash.xxh64_intdigest(x) for x in slots], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "grade", "key", "slots", "shares"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slot of a task, with the number of its documents of each grade."""
    counts = np.zeros((TOP_GRADE + 1, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for grade, slots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[grade, np.frombuffer(slots.as_buffer(), "<i4")] += 1  # a text has a slot once
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at]) for c in counts)], names=["slot", *(f"n{g}" for g in range(TOP_GRADE + 1))])


def _starts(chunk: pa.Array) -> np.ndarray:
    """Offsets of a binary array's values, the last one's end included."""
    return np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]


def score_text(text: bytes, model: Ordinal, shares: dict[bytes, float], presences: dict[bytes, float]) -> float:
    words = text.split()
    if not words:
        return 0.0
    weight, distinct = model.known().get, set(words)
    for w in distinct.difference(shares):
        share, presence = word_slots(w)
        shares[w], presences[w] = sum([weight(i, 0.0) for i in share]), sum([weight(i, 0.0) for i in presence])
    same = sum(map(bytes.__eq__, words, words[1:]))
    # fsum: a document's score doesn't hang on the order of a set
    return (math.fsum(map(shares.__getitem__, words)) + same * weight(_REPEAT, 0.0)) * (SCALE / len(words)) + math.fsum(map(presences.__getitem__, distinct))


def graded(docs: DataFrame, model: Ordinal, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability double, kept boolean): one pass, no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[bytes, float] = {}
        presences: dict[bytes, float] = {}
        for batch in batches:
            scores = []
            for t in texts_of(batch.column(1)):
                if len(shares) > CACHE_WORDS:
                    shares.clear()
                    presences.clear()
                scores.append(score_text(t, model, shares, presences))
            s = np.array(scores, float)
            tails = model.tails(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= CUT)], names=["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(compute, f"doc_id {kind}, score double, expected_grade double, tail_probability double, kept boolean")
