"""Quality rules: base statistics of a text, and gradient-boosted trees over them.

The trees are grown here, by histogram splits on the logistic loss, from the `quality` labels of at most `SAMPLE`
documents (those of smallest hash, so reruns agree). Chosen features are monotonic: a higher share of symbols, capitals,
repeated lines or repeated passages never raises a verdict. All trees are flattened into numpy node arrays, and a batch of
documents walks all trees at once.

Defined results: a null text has no words; a text of fewer than 10 words, or with more than a fifth of its words in
repeated windows, fails the base rules and isn't kept; without labels of both kinds the trees keep all; a null id stays
null; repeated rows get a row each; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import texts_of

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 8192
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Longer texts count their windows by sorting, in a few bytes a word.
LONG = 4096
CUT = 0.5

#: Name and direction of each feature: -1 where more never raises the verdict, 0 where the trees are free.
FEATURES = (
    ("log_words", 0),
    ("mean_word", 0),
    ("symbols", -1),
    ("capitals", -1),
    ("digits", 0),
    ("exclamations", -1),
    ("other_marks", 0),
    ("dup_lines", -1),
    ("repeat_words", -1),
    ("same_as_previous", -1),
    ("distinct_words", 0),
    ("words_a_line", 0),
    ("lone_marks", -1),
    ("non_ascii", 0),
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that the text has twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    if n < LONG:
        windows = list(zip(*(words[i:] for i in range(width))))
        count = Counter(windows)
        if len(count) == n:
            return 0
        hits = np.fromiter((count[w] > 1 for w in windows), bool, n)
    else:
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        names = codes[:n]
        for i in range(1, width):  # names of windows of i + 1 words, from those of i
            names = np.unique(names * len(number) + codes[i : i + n], return_inverse=True)[1]
        hits = np.bincount(names)[names] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    words = text.split()
    n = len(words)
    n_chars = len(text.decode("utf-8", "replace"))
    word_chars = n_chars - (len(text) - len(text.translate(None, SPACES)))
    count = lambda marks: len(text) - len(text.translate(None, marks))
    n_symbols = count(SYMBOLS)
    seen: set[bytes] = set()
    lines = n_dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    n_repeat = repeat_words(words)
    some, letters = max(1, word_chars), max(1, count(_LETTERS))
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lone = sum(1 for w in words if len(w) == 1 and not w.isalnum()) if n else 0
    features = [
        np.log1p(n),
        word_chars / max(1, n),
        n_symbols / some,
        count(_UPPER) / letters,
        count(_DIGITS) / some,
        text.count(b"!") / some,
        count(_MARKS) / some,
        n_dup / max(1, lines),
        n_repeat / max(1, n),
        same / max(1, n),
        len(set(words)) / max(1, n),
        n / max(1, lines),
        lone / max(1, n),
        count(_HIGH) / max(1, len(text)),
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


@dataclass
class Trees:
    """Flat nodes of all trees: a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row, all trees at once."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            some = x[lo : lo + 4096]
            node = np.broadcast_to(self.roots, (len(some), len(self.roots)))
            row = np.arange(len(some))[:, None]
            for _ in range(self.depth):
                node = np.where(some[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[lo : lo + 4096] += self.value[node].sum(axis=1)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, directions: tuple[int, ...], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosted trees for P(y = 1). A split on a monotonic feature must order its children, and bounds hand that down."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    base = float(np.log(mean / (1 - mean)))
    if not 0 < y.sum() < len(y):
        rounds = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if rounds else []
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if rounds else x
    score = np.full(len(x), base)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def gain_at(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        at = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, at), (right, at), (value, rate * leaf(g[rows].sum(), h[rows].sum(), lo, hi))):
            a.append(v)
        if level == depth or len(rows) < 2 * least:
            return at
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (float(gain_at(np.float64(leaf(gs, hs, lo, hi)), gs, hs)) + 1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = codes[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
            total = gain_at(wl, gl, hl) + gain_at(wr, gs - gl, hs - hl)
            total[(nl < least) | (len(rows) - nl < least) | (directions[j] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(total))
            if total[k] > best[0]:
                best = (float(total[k]), (j, k, wl[k], wr[k]))
        if best[1] is None:
            return at
        j, k, wl, wr = best[1]
        mid = (wl + wr) / 2
        bounds = [(lo, hi), (lo, hi)] if not directions[j] else [(lo, mid), (mid, hi)] if directions[j] > 0 else [(mid, hi), (lo, mid)]
        goes = codes[rows, j] <= k
        feature[at], threshold[at] = j, float(edges[j][k])
        left[at] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[at] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return at

    made = lambda: Trees(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), np.array(roots, np.int64), depth, base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        at = len(feature)
        roots.append(at)
        grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf)
        one = made()
        one.roots, one.base = np.array([at]), 0.0
        score += one.score(x)
    return made() if roots else Trees(np.zeros(1, np.int64), np.full(1, np.inf), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), 1, base if len(y) and y.sum() == 0 else 10.0)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame, trees: Trees | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, the base statistics, features array<double>, log_odds double): one pass, no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in texts_of(batch.column(1))]
            if not both:
                continue
            base, x = np.array([b for b, _ in both], np.int64), np.array([f for _, f in both], float)
            odds = trees.score(x) if trees is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in base.T), pa.array(list(x), pa.list_(pa.float64())), pa.array(odds)], names=["doc_id", *BASE, "features", "log_odds"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(compute, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in BASE)}, features array<double>, log_odds double")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents with labels, at most about `sample`: the labels of smallest hash are found first, so few texts move."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(2 * sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    chosen = labelled_sample(docs, labels, sample)
    rows = _with_quality(chosen)
    data = rows.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(data["features"].to_numpy()) if len(data) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, data["quality"].to_numpy(float), tuple(d for _, d in FEATURES))


def _with_quality(chosen: DataFrame) -> DataFrame:
    """Features and label of each chosen row; the label travels in place of the id."""
    packed = chosen.select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    return document_statistics(packed).select("doc_id.doc_id", "doc_id.quality", "features")


def quality_rules(docs: DataFrame, trees: Trees, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, base statistics, base_failed boolean, kept boolean, log_odds double)."""
    rows = document_statistics(docs, trees, id_column)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("log_odds") >= float(np.log(CUT / (1 - CUT))))).alias("kept"), "log_odds")
