"""LM scoring by online logistic context mixing.

A text is its lower-cased words and an end, coded as bits: a word of the dictionary (the `TOP_WORDS` commonest training words
that occur `MIN_COUNT` times) by its path in a Huffman tree, any other by the path of an escape and then by what it is. Five
predictors give a logit for each bit of a path, from hashed contexts:
  * the tree node alone, from all training texts;
  * the node after the word before (a common word itself, of others the last two bytes), from all training texts;
  * the node in what the passage itself has said so far;
  * the word that followed the word before when the passage last had it, for as long as the path agrees with it;
  * the corpus memory: the word that most often followed the two words before, likewise.
They are mixed logistically: the weights hang on how often each context was seen and on a gate, the state of the memory (how
often the word followed, and how contested). The weights are learned online: in each block of texts, a step of bits is scored
by the weights so far and then learned from, where the text is a training text. A table corrects the mixed probability
adaptively, per gate and size, likewise. An escaped
word is told by further bits, whose probabilities are adaptive: is it the one that the memory expects, is it one that the
passage has used; else it is a mixture of the corpus's counts of rare words and of a spelling, whose bytes are coded by their Huffman
paths and a mixer of the same kind over the bytes before. All steps give probabilities that sum to one at most, so `score` is log10 of a
proper code's probability of the text.

What is gathered grows with the corpus and is exact: the count of every distinct word, and the memory, the followers of every
pair of words. Neither is broadcast: the memory is cut into shards by a hash of the pair, of about `SHARD_KEYS`
pairs each, as many as the corpus needs, and every block of texts asks each shard once, also for the counts and the spelling of
its rare words, dealt by a hash of the word, and is scored where the answers arrive.
Of a pair a block tells its `TELL` commonest followers, so even a pair found everywhere brings a shard a few rows a block.
What is broadcast has a fixed size: the dictionary, the table of words after words before (`AFTER_BITS`) and the tables of
the spelling (`TABLE_BITS`).

Own text is left out: where a training text is scored, its own occurrences are taken from the counts that predict it.
A passage is a text, or a part of `PASSAGE` tokens of a longer one.

Defined results: a null text counts as empty and has its end only; a null id counts as the text "" in the split into
training and held-out; repeated rows are scored and learned one by one; with no training text nothing is known and words are
spelled in even bits; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

END = b"\n"
TOP_WORDS = 200_000
MIN_COUNT = 3
FLUSH_WORDS = 250_000
#: A block's text, about, and its texts at most; tokens of a passage at most.
BLOCK_BYTES = 4 << 20
BLOCK_TEXTS = 1 << 14
PASSAGE = 1 << 16
UNIT = 1 << 13
#: The corpus memory: pairs of words in a shard, followers of a pair that a block tells.
SHARD_KEYS = 1 << 21
TELL = 8
#: Words after words that are folded before the table of such gets them.
PAIRS = 1 << 21
#: Words whose context is themselves; of the others it is their end.
OWN_CONTEXT = 8192
AFTER_BITS = 22
PARTS = 16
#: Codes of words in the memory: the dictionary's numbers, and hashes of other words from here to 2^24.
RARE_CODE = 1 << 18

#: Spelling: slots of the tables of its six contexts, as powers of two; words of a group that learns by itself.
TABLE_BITS = (12, 16, 18, 20, 20, 21)
GROUP_WORDS = 1 << 17
SEGMENT = 1 << 14
SHARED = 24
BATCH = 1 << 12
STEP = 1 << 12

PRIOR = 0.3
LEVELS = 8
BUCKETS = 33
INPUTS = 5
STATES = 16
RATE = 0.06

_SALT = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(8)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_START = np.uint64(0x5851F42D4C957F2D)
_LOW24 = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + _SALT[1]) * _MIX
        x ^= x >> np.uint64(31)
        x *= _MIX
        return x ^ (x >> np.uint64(29))


def quantized(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot's logit in sixteenths, and how often it was seen: 0 to 8 as such, then by eighths of a doubling."""
    logit = np.log((ones + PRIOR) / (n - ones + PRIOR))
    seen = np.where(n <= 8, np.round(n), 8 + np.floor(8 * np.log2(np.maximum(n, 8) / 8)))
    return np.clip(np.round(16 * logit), -127, 127).astype(np.int8), np.minimum(seen, 255).astype(np.uint8)


_SEEN = np.concatenate((np.arange(9), 8 * 2 ** ((np.arange(9, 256) - 8) / 8))).astype(np.float32)
_LEVEL = np.minimum(LEVELS - 1, np.concatenate(([0], 1 + np.floor(np.log2(_SEEN[1:])).astype(int)))).astype(np.int32)


def level_of(n: np.ndarray) -> np.ndarray:
    """0 for nothing seen, then by doublings: a number's exponent."""
    return np.clip((n.astype(np.float32, copy=False).view(np.int32) >> 23) - 126, 0, LEVELS - 1)


def together(logit: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A logit and its level in one number, the level in the lowest bits of the fraction, so that a look-up meets both."""
    return (logit.astype(np.float32).view(np.uint32) & ~np.uint32(LEVELS - 1)) | level.astype(np.uint32)


def apart(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, level)."""
    return (both & ~np.uint32(LEVELS - 1)).view(np.float32), both & np.uint32(LEVELS - 1)


def less_own(logit: np.ndarray, seen: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, level) of slots that were seen, once the bit itself is taken out of their counts."""
    n = _SEEN[seen]
    ones = (n + np.float32(2 * PRIOR)) / (1 + np.exp(-logit)) - np.float32(PRIOR)
    n = n - 1
    return _logit(n, np.minimum(np.maximum(ones - bits, 0), n)), level_of(n)


def step_size(seen: int) -> int:
    """Bits of the next online step: few at first, to get going on a small table."""
    return min(STEP, max(STEP >> 5, seen >> 4))


@dataclass
class Mixer:
    """Weights by gate, input and level, and the correcting table by gate and size."""

    weights: np.ndarray
    ones: np.ndarray
    all: np.ndarray
    seen: int = 0

    @staticmethod
    def blank(gates: int, inputs: int) -> Mixer:
        return Mixer(np.full(gates * inputs * LEVELS, 0.3, np.float32), np.zeros(gates * BUCKETS), np.zeros(gates * BUCKETS))

    def dotted(self, x: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mixed logit, bucket of the correcting table), which begins at `base`."""
        dot = np.einsum("ij,ij->j", self.weights.take(at), x)
        np.clip(dot, -11.9, 11.9, out=dot)
        bucket = ((dot + 12) * np.float32((BUCKETS - 1) / 24) + np.float32(0.5)).astype(np.int64)
        bucket += base
        return dot, bucket

    def probability(self, x: np.ndarray, at: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mixed P(bit = 1), bucket of the correcting table); `at` has the weight of each input."""
        dot, bucket = self.dotted(x, at, gate * BUCKETS)
        np.negative(dot, out=dot)
        return _sigmoid_of_less(dot), bucket

    def corrected(self, p: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (p + (self.ones.take(bucket) + p) / (self.all.take(bucket) + 1)) / 2

    def learn(self, x: np.ndarray, at: np.ndarray, gate: np.ndarray, bits: np.ndarray, squares: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
        """log2 of the probability that each bit had when it came, in online steps, learned from the bits in `use`.

        What is computed is the probability of the bit that came, P(1) or P(0), so that none is lost in a difference from one.
        """
        out, lo = np.empty(len(bits), np.float32), 0
        times, plus = np.empty((2, 2 * len(self.all)), np.float32)
        base, other = gate * BUCKETS, np.float32(1) - bits * np.float32(2)
        while lo < len(bits):
            s = slice(lo, lo + step_size(self.seen + lo))
            lo = s.stop
            xs, ws = np.ascontiguousarray(x[:, s]), np.ascontiguousarray(at[:, s])
            dot, bucket = self.dotted(xs, ws, base[s])
            dot *= other[s]
            p = _sigmoid_of_less(dot)
            bucket *= 2
            bucket += bits[s]
            # As `corrected` does, a row for each bit: (p + (ones + p) / (all + 1)) / 2.
            share = 0.5 / (self.all + 1)
            times[0::2] = times[1::2] = 0.5 + share
            plus[0::2], plus[1::2] = (self.all - self.ones) * share, self.ones * share
            out[s] = p * times.take(bucket) + plus.take(bucket)
            n = len(p)
            p -= 1
            p *= other[s]
            np.negative(p, out=p)
            if use is not None:
                some = use[s]
                n = np.count_nonzero(some)
                if n < len(p):
                    p *= some
                    bucket = bucket[some]
            if n:
                counts = np.bincount(bucket, minlength=2 * len(self.all))
                self.ones += counts[1::2]
                self.all += counts[0::2] + counts[1::2]
                slope = np.bincount(ws.ravel(), (p * xs).ravel(), len(self.weights)) / n
                squares += slope * slope
                self.weights -= (RATE * slope / np.sqrt(squares)).astype(np.float32)
        self.seen += len(bits)
        return np.log(out) * np.float32(math.log2(math.e))


def _sigmoid_of_less(x: np.ndarray) -> np.ndarray:
    """The logistic function of -x, in its place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of `values array<double>` by place, exact to six decimals in any order; empty without rows."""
    parts = rows.select(F.posexplode("values").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(30,6)")).cast("double").alias("x"))
    got = parts.toPandas().sort_values("i")
    return got["x"].to_numpy(float)


def averaged(total: np.ndarray, like: Mixer) -> Mixer:
    """A mixer from summed values whose weights were multiplied by the mass, which comes first."""
    k, t = len(like.weights), len(like.ones)
    if not len(total) or not total[0]:
        return like
    return Mixer((total[1 : k + 1] / total[0]).astype(np.float32), total[k + 1 : k + 1 + t], total[k + 1 + t : k + 1 + 2 * t])


def packed_values(mass: float, mixer: Mixer, more: np.ndarray | None = None) -> np.ndarray:
    return np.concatenate([[mass], mixer.weights * mass, mixer.ones, mixer.all, *([] if more is None else [more])])


# Spelling: words outside the dictionary, bit by bit.

OFFSETS = tuple(int(x) for x in np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS]))))
SLOTS = OFFSETS[-1]
GATES = len(TABLE_BITS) + 1


def units(word: bytes) -> list[bytes]:
    """What is coded for a word: its bytes and a blank, in segments; contexts start anew at a segment."""
    coded = word + b" "
    return [coded] if len(coded) <= SEGMENT else [coded[i : i + SEGMENT] for i in range(0, len(coded), SEGMENT)]


def contexts(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each context at each byte, the bytes, the segment of each byte).

    The contexts are the place in the word, the 1, 2, 3 and 4 bytes before, and the word so far.
    """
    data = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64)
    n = len(data)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n) - starts
    out = np.empty((len(TABLE_BITS), n), np.uint64)
    with np.errstate(over="ignore"):
        out[0] = np.minimum(place, 20).astype(np.uint64) + np.uint64(1)
        order = np.zeros(n, np.uint64)
        for k in range(1, 5):
            before = np.zeros(n, np.uint64)
            before[k:] = data[:-k] if k < n else data[:0]
            before = np.where(place >= k, before + np.uint64(1), np.uint64(0))
            order = order * np.uint64(257) + before
            out[k] = order
        powers = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
        up, down = powers(_BASE), powers(_INVERSE)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:n])))
        out[5] = (total[:n] - total[starts]) * down[starts] + place.astype(np.uint64)
        for i in range(len(out)):
            out[i] = mixed(out[i] + _SALT[i])
    return out, data, np.repeat(np.arange(len(segments)), sizes)


def bit_slots(code: tuple, hashes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each context at each bit, the bits, the byte of each): bits are those of the bytes' Huffman paths."""
    starts, depth, nodes, bits = code
    data = data.astype(np.int64)
    sizes = depth[data]
    owner = np.repeat(np.arange(len(data)), sizes)
    at = starts[data][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    salted = nodes[at].astype(np.uint64) * _SALT[7]
    slots = np.empty((len(hashes), len(owner)), np.uint32)
    with np.errstate(over="ignore"):
        for i, b in enumerate(TABLE_BITS):
            slots[i] = (((hashes[i][owner] ^ salted) * _MIX) >> np.uint64(64 - b)).astype(np.uint32) + np.uint32(OFFSETS[i])
    return slots, bits[at], owner


def spelled_once(segments: list[bytes], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes that don't continue a beginning shared with the segment before, of each byte which of these it is or repeats).

    A byte's contexts and path hang on its segment up to it alone. Of a beginning, `SHARED` bytes at most are looked at.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
    heads = np.array(segments, f"S{SHARED}").view(np.uint8).reshape(-1, SHARED)
    shared = np.zeros(len(segments), np.int64)
    shared[1:] = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1).sum(1)
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    new = np.flatnonzero(place >= shared[of])
    number = np.full(len(of), -1)
    number[new] = np.arange(len(new))
    last, head = np.full((len(segments), SHARED), -1), np.flatnonzero(place < SHARED)
    last[of[head], place[head]] = number[head]
    last = np.maximum.accumulate(last, axis=0)
    return new, np.where(number >= 0, number, last[of, np.minimum(place, SHARED - 1)])


def byte_code(words: list[bytes]) -> tuple:
    """The Huffman code of bytes, from the letters of the dictionary's words, each byte counted once more."""
    n = np.ones(256, np.int64)
    for word in words:
        n += np.bincount(np.frombuffer(word + b" ", np.uint8), minlength=256)
    return huffman(n)[:4]


@dataclass
class Speller:
    code: tuple
    slots: Slots
    mixer: Mixer

    def inputs(self, slots: np.ndarray, own: bool, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, weight of each, gate: the longest context seen), with the word itself left out of the counts if `own`."""
        x, levels = self.slots.inputs(slots, bits + 1 if own else None)
        found = levels > 0
        gate = np.zeros(slots.shape[1], np.int32)
        for i in range(len(slots)):
            gate[found[i]] = i + 1
        at = levels + (np.arange(len(slots), dtype=np.int32) * LEVELS)[:, None] + gate * np.int32(len(slots) * LEVELS)
        return x, at, gate

    def log2_words(self, words: list[bytes], own: bool) -> np.ndarray:
        """log2 of the probability of each word, in batches of a bounded size: in order, so that beginnings that are shared are spelled once."""
        out = np.zeros(len(words))
        segments, owner, size = [], [], 0

        def flush() -> None:
            hashes, data, of = contexts(segments)
            new, source = spelled_once(segments, of)
            slots, bits, byte = bit_slots(self.code, hashes[:, new], data[new])
            p, bucket = self.mixer.probability(*self.inputs(slots, own, bits))
            p = self.mixer.corrected(p, bucket)
            each = np.bincount(byte, np.log(np.abs(p - (1 - bits)).astype(np.float32))) * math.log2(math.e)
            np.add.at(out, np.array(owner), np.bincount(of, each[source]))
            segments.clear()
            owner.clear()

        for i in sorted(range(len(words)), key=words.__getitem__):
            for u in units(words[i]):
                segments.append(u)
                owner.append(i)
                size += len(u)
                if size >= SEGMENT:
                    flush()
                    size = 0
        if segments:
            flush()
        return out


def _word_batches(words: list[bytes], batch_bytes: int) -> Iterator[list[bytes]]:
    segments, size = [], 0
    for word in words:
        for u in units(word):
            segments.append(u)
            size += len(u)
            if size >= batch_bytes:
                yield segments
                segments, size = [], 0
    if segments:
        yield segments


def _table_parts(zeros: np.ndarray, ones: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, raw): slices of two tables of counts, those that aren't empty, after the size of a count."""
    width = -(-len(zeros) // parts)
    for i in range(parts):
        part = np.stack([zeros[i * width : (i + 1) * width], ones[i * width : (i + 1) * width]])
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([bytes([part.itemsize]) + squeezed(part)], pa.binary())], names=["part", "raw"])


def squeezed(x: np.ndarray) -> bytes:
    """Compressed, after its shape: all first bytes of the numbers, all second bytes, and so on."""
    raw = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(x.size, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def expanded(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    plain = pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def joined(words: list[bytes]) -> bytes:
    """Words, which have no blanks and aren't empty, as one compressed string."""
    return squeezed(np.frombuffer(b" ".join(words), np.uint8))


def parted(raw: bytes) -> list[bytes]:
    return expanded(raw, "u1").tobytes().split(b" ") if raw else []


class Slots:
    """Logits and numbers seen, quantized, side by side so that a look-up meets both; sent compressed."""

    def __init__(self, logit: np.ndarray, seen: np.ndarray):
        self.both = logit.view(np.uint8) | seen.astype("<u2") << 8

    def __reduce__(self):
        return Slots.of, (squeezed(self.both),)

    @staticmethod
    def of(both: bytes) -> Slots:
        out = Slots.__new__(Slots)
        out.both = expanded(both, "<u2")
        return out

    def inputs(self, at: np.ndarray, own_bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(logit, level) of slots; where `own_bits` is 1 or 2, one's own bit, 0 or 1, is taken out of the counts."""
        look = self.both.take(at)
        if own_bits is not None:
            look = look + (own_bits.astype(np.int64) << 16)
        return apart(looked_up().take(look))


@cache
def looked_up() -> np.ndarray:
    """Logit and level, `together`, of everything that a slot can hold: as it is, without a bit 0 of one's own, without a bit 1."""
    seen, logit = np.divmod(np.arange(1 << 16), 256)
    x, level = logit.astype(np.uint8).view(np.int8) * np.float32(1 / 16), _LEVEL[seen]
    few = np.flatnonzero((seen > 0) & (level < LEVELS - 1))  # else one's own are too few to tell
    logits, levels = np.tile(x, (3, 1)), np.tile(level, (3, 1))
    for bit in (0, 1):
        logits[1 + bit, few], levels[1 + bit, few] = less_own(x[few], seen[few], np.full(len(few), bit, np.uint8))
    return together(logits.ravel(), levels.ravel())


def quantized_table(parts: DataFrame, n_tasks: int, slots: int, n_parts: int) -> Slots:
    """The tables of (part, raw) rows added up, in two levels so that no group meets more than about a root of the tasks, and quantized."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        for raw in rows.column("raw"):
            one = expanded(raw.as_py()[1:], f"<i{raw.as_py()[0]}")
            total = one.astype(np.int64) if not len(total) else total + one
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "raw": pa.array([bytes([8]) + squeezed(total)], pa.binary())})

    width = -(-slots // n_parts)
    salts = max(1, math.isqrt(n_tasks))
    if salts > 1:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("raw"), F.lit(salts)))
        parts = salted.groupBy("part", "salt").applyInArrow(lambda rows: add(rows), "part int, raw binary")
    logit, seen = np.zeros(width * n_parts, np.int8), np.zeros(width * n_parts, np.uint8)
    for part, raw in parts.groupBy("part").applyInArrow(lambda rows: add(rows), "part int, raw binary").toPandas().itertuples(index=False):
        zeros, ones = expanded(raw[1:], "<i8").reshape(2, -1).astype(float)
        at = slice(part * width, part * width + len(ones))
        logit[at], seen[at] = quantized(zeros + ones, ones)
    return Slots(logit[:slots], seen[:slots])


def learn_spelling(rare: DataFrame, n_words: int, code: tuple) -> Speller:
    """From the distinct words outside the dictionary, in groups by hash, each sorted, so reruns agree.

    Each word counts once, however often it occurs: what is spelled is new words.
    """
    groups = max(1, -(-n_words // GROUP_WORDS))
    grouped = rare.select("word", F.pmod(F.xxhash64("word"), F.lit(groups)).alias("part"))
    speller = Speller(code, Slots(np.zeros(SLOTS, np.int8), np.zeros(SLOTS, np.uint8)), Mixer.blank(GATES, len(TABLE_BITS)))
    if not n_words:
        return speller

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 * SLOTS, np.int32)
        for batch in batches:
            for segments in _word_batches(sorted(listed(batch.column(0))), SEGMENT):
                hashes, data, of = contexts(segments)
                new, source = spelled_once(segments, of)
                slots, bits, byte = bit_slots(code, hashes[:, new], data[new])
                np.add.at(both, (2 * slots + bits).ravel(), np.tile(np.bincount(source).astype(np.int32).take(byte), len(slots)))
        yield from _table_parts(both[::2], both[1::2], PARTS)

    speller.slots = quantized_table(rare.select("word").mapInArrow(add_up, "part int, raw binary"), groups, SLOTS, PARTS)
    sent = rare.sparkSession.sparkContext.broadcast(speller.slots)

    def online(rows: pa.Table) -> pa.Table:
        own, squares, mass = Speller(code, sent.value, Mixer.blank(GATES, len(TABLE_BITS))), np.full(GATES * len(TABLE_BITS) * LEVELS, 1e-6), 0.0
        for segments in _word_batches(sorted(listed(rows.column("word").combine_chunks())), BATCH):
            hashes, data, _ = contexts(segments)
            slots, bits, _ = bit_slots(code, hashes, data)
            own.mixer.learn(*own.inputs(slots, True, bits), bits, squares)
            mass += len(bits)
        return pa.table({"values": pa.array([packed_values(mass, own.mixer).tolist()], pa.list_(pa.float64()))})

    speller.mixer = averaged(summed(grouped.groupBy("part").applyInArrow(lambda rows: online(rows), "values array<double>")), speller.mixer)
    sent.destroy()
    return speller


# The dictionary and its code.


@dataclass
class Dictionary:
    """Words by falling count and the paths of their code; the escape's number is that of words."""

    number: dict[bytes, int]
    log10_n: np.ndarray
    starts: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    path: np.ndarray
    node_n: np.ndarray
    node_ones: np.ndarray
    node_look: np.ndarray
    steps: np.ndarray
    hashes: np.ndarray
    after: np.ndarray
    made_of: tuple

    def __reduce__(self):
        """Sent as the words and counts that it is made of, which are a small part of it."""
        return dictionary_of, self.made_of


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, depths, nodes, bits, n, ones): the path of each symbol from the root, end to end, and the counts of each node."""
    m = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * m - 1, np.int64), np.zeros(2 * m - 1, np.uint8)
    n, ones = np.zeros(max(1, m - 1)), np.zeros(max(1, m - 1))
    for k in range(m - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = m + k
        side[i] = 1
        n[k], ones[k] = a + b, a
        heapq.heappush(heap, (a + b, m + k))
    at, levels = np.arange(m), []
    while (at != 2 * m - 2).any():
        on = at != 2 * m - 2
        levels.append((on, np.where(on, parent[at] - m, 0), np.where(on, side[at], 0)))
        at = np.where(on, parent[at], at)
    depth = np.sum([on for on, _, _ in levels], axis=0, dtype=np.int64) if levels else np.zeros(m, np.int64)
    starts = np.cumsum(depth) - depth
    nodes, bits = np.zeros(int(depth.sum()), np.int64), np.zeros(int(depth.sum()), np.uint8)
    for up, (on, node, bit) in enumerate(levels):
        where = starts[on] + depth[on] - 1 - up
        nodes[where], bits[where] = node[on], bit[on]
    return starts, depth, nodes, bits, n, ones


def path_numbers(starts: np.ndarray, depth: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each path as a number of 64 bits, from the highest on: a path of more would take more than 10^13 tokens."""
    assert depth.max() <= 64
    out = np.zeros(len(depth), np.uint64)
    for k in range(int(depth.max())):
        on = np.flatnonzero(depth > k)
        out[on] |= bits[starts[on] + k].astype(np.uint64) << np.uint64(63 - k)
    return out


def end_contexts(words: list[bytes]) -> np.ndarray:
    """The contexts that less common words make for the next one: their last two bytes."""
    flat = np.frombuffer(b"\0" + b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return (OWN_CONTEXT + 1 + 256 * flat[ends - 1].astype(np.int32) + flat[ends]).astype(np.int32)


def dictionary_of(words: list[bytes], counts: list[int], n_rare: int) -> Dictionary:
    c = np.array([*counts, n_rare + 1], np.int64)
    starts, depth, nodes, bits, n, ones = huffman(c)
    after = np.where(np.arange(len(words)) < OWN_CONTEXT, np.arange(len(words)) + 1, end_contexts(words)).astype(np.int32)
    return Dictionary({w: i for i, w in enumerate(words)}, np.log10(np.array(counts, float) + 0.5), starts, depth, nodes.astype(np.int32), bits, path_numbers(starts, depth, bits), n, ones, together(_logit(n, ones), level_of(n)), (nodes << 1 | bits).astype(np.int32), mixed(np.arange(len(words), dtype=np.uint64)), after, (words, counts, n_rare))


def is_held_out(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, end to end, and how many each has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():  # outer white space gives empty words
        ends = np.concatenate(([0], np.cumsum(full)))
        sizes = np.diff(ends[np.concatenate(([0], np.cumsum(sizes)))])
        words = words.filter(pa.array(full))
    return words, sizes


def listed(words: pa.Array) -> list[bytes]:
    """Words, which have no blanks and aren't empty, taken out of Arrow in one string."""
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_binary())), pa.scalar(b" ", pa.large_binary()))
    return whole[0].as_py().split(b" ") if len(words) else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long) of all texts, each with its end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = new = 0

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.column(0).slice(lo, 2048)
                words, _ = split_words(some)
                found = words.cast(pa.binary()).value_counts()
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                ends += len(some)
                new += len(found)
                if new > FLUSH_WORDS:
                    held, new = [together()], 0
                    if len(held[0]) > FLUSH_WORDS:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from together().to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# Blocks of texts as symbols.

_BLOCK = "block bigint, ids array<{kind}>, held array<boolean>, n_bytes array<bigint>, sizes array<bigint>, symbols binary, rare binary"


def blocks_of(rows: DataFrame, sent) -> DataFrame:
    """One row a block: its texts' ids, and their words as numbers: of the dictionary, or -1 - place among the block's rare words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = sent.value.number, TaskContext.get().partitionId() << 20
        end = number.get(END, 0)
        for batch in batches:
            texts = batch.column(1)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
            of = np.cumsum(size) // BLOCK_BYTES + np.arange(len(size)) // BLOCK_TEXTS
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                found, sizes = split_words(texts.slice(lo, hi - lo))
                coded = found.cast(pa.binary()).dictionary_encode()
                distinct = listed(coded.dictionary)
                ids = np.fromiter(map(number.get, distinct, repeat(-1)), np.int32, len(distinct))
                rare = np.flatnonzero(ids < 0)
                ids[rare] = -1 - np.arange(len(rare), dtype=np.int32)
                ends = np.cumsum(sizes + 1) - 1
                symbols = np.full(len(found) + len(sizes), end, np.int32)
                is_word = np.ones(len(symbols), bool)
                is_word[ends] = False
                symbols[is_word] = ids[np.asarray(coded.indices)] if len(ids) else 0
                one = lambda column, kind: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column if kind is None else pa.array(column, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), one(pa.concat_arrays([batch.column(0).slice(lo, hi - lo)]), None), one(pa.concat_arrays([batch.column(2).slice(lo, hi - lo)]), None), one(size[lo:hi], pa.int64()), one(sizes + 1, pa.int64()), pa.array([squeezed(symbols)], pa.binary()), pa.array([joined([distinct[i] for i in rare.tolist()])], pa.binary())],
                    names=["block", "ids", "held", "n_bytes", "sizes", "symbols", "rare"],
                )
                block += 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(cut, _BLOCK.format(kind=kind))


@dataclass
class Block:
    """A block's tokens, and what is told of each: its passage, whether that is held out, and the contexts it stands in."""

    symbols: np.ndarray
    passage: np.ndarray
    held: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    pair: np.ndarray
    after: np.ndarray
    rare_hash: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, held: np.ndarray, symbols: np.ndarray, rare: list[bytes], book: Dictionary) -> Block:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(symbols)) - starts[doc]
        per_doc = -(-sizes // PASSAGE)
        passage = (np.cumsum(per_doc) - per_doc)[doc] + place // PASSAGE
        rare_hash = hashes_of(rare)
        # Rare words are numbered behind those of the dictionary, to look all up alike.
        at = np.where(symbols < 0, len(book.number) - 1 - symbols, symbols)
        hashes = np.concatenate([book.hashes, rare_hash])[at]
        code = np.concatenate([np.arange(len(book.number)), RARE_CODE + (rare_hash % np.uint64((1 << 24) - RARE_CODE)).astype(np.int64)])[at]
        one, two = np.full(len(symbols), _START), np.full(len(symbols), _START)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[starts] = two[starts] = _START
        two[starts[sizes > 1] + 1] = _START
        with np.errstate(over="ignore"):
            pair = mixed(one * _BASE + two)
        return Block(symbols, passage, held[doc], doc, code, pair, words_before(starts, symbols, rare, book), rare_hash)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def words_before(starts: np.ndarray, symbols: np.ndarray, rare: list[bytes], book: Dictionary) -> np.ndarray:
    """The context that the word before each token makes, 0 at the start of a text."""
    after = np.concatenate([book.after, end_contexts(rare)]).take(np.where(symbols < 0, len(book.number) - 1 - symbols, symbols))
    before = np.zeros(len(symbols), np.int32)
    before[1:] = after[:-1]
    before[starts] = 0
    return before


def _block_of(row: dict, book: Dictionary) -> tuple[Block, list[bytes]]:
    """(the block of a row, its rare words)."""
    rare = parted(row["rare"])
    return Block.of(np.array(row["sizes"], np.int64), np.array(row["held"], bool), expanded(row["symbols"], "<i4"), rare, book), rare


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# The corpus memory.


def shard_bits(n_tokens: int) -> int:
    return min(31, max(0, math.ceil(math.log2(max(1, n_tokens / SHARD_KEYS)))))


def pairs_of(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs, ordered, the place of each token's pair among them); a pair is known by `bits` + 32 bits of its hash."""
    short = block.pair >> np.uint64(32 - bits)
    order = np.argsort(short)
    new = np.concatenate((np.ones(min(1, len(order)), bool), short[order[1:]] != short[order[:-1]]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return short[order][new], rank


_ASK = "shard int, block bigint, keys binary, meta binary, words binary, n binary, rare binary, rare_n binary"
_TOLD = "block bigint, shard int, best binary, best_n binary, next binary, next_n binary, times binary, spelled_own binary, spelled binary"


def rare_shards(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each word outside the dictionary, by the high bits of its hash."""
    return (hashes >> np.uint64(32) >> np.uint64(32 - bits)).astype(np.int64)


def rare_uses(block: Block, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often the block's training texts have each of its rare words, whether its held-out texts have it)."""
    at = block.symbols < 0
    word, held = -1 - block.symbols[at], block.held[at]
    return np.bincount(word[~held], minlength=n_words), np.bincount(word[held], minlength=n_words) > 0


def questions(blocks: DataFrame, bits: int, sent) -> DataFrame:
    """Of each block, for each shard: the pairs it asks about, and the commonest training followers it knows of them; its rare words and twice
    their training counts, odd if a held-out text has the word."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, rare = _block_of(row, sent.value)
            if not len(block.symbols):
                continue
            pairs, rank = pairs_of(block, bits)
            first, last = np.full(len(pairs), np.iinfo(np.int64).max), np.zeros(len(pairs), np.int64)
            np.minimum.at(first, rank, block.passage)
            np.maximum.at(last, rank, block.passage)
            use = ~block.held
            told = np.sort((rank[use] << 24) | block.code[use])
            cuts = np.flatnonzero(np.diff(told, prepend=-1))
            n = np.minimum(np.diff(np.append(cuts, len(told))), 255)
            told = told[cuts]
            # By pair, then by falling count, then by word.
            ordered = np.sort(((told >> 24) << 32) | ((255 - n) << 24) | (told & ((1 << 24) - 1)))
            owner = ordered >> 32
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            ordered = ordered[nth < TELL]
            owner, n, words = ordered >> 32, (255 - ((ordered >> 24) & 255)).astype(np.uint8), (ordered & ((1 << 24) - 1)).astype("<u4")
            per_pair = np.bincount(owner, minlength=len(pairs))
            meta = (per_pair | np.where(last > first, 128, 0)).astype(np.uint8)
            keys = (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(per_pair)))
            learned, asked = rare_uses(block, len(rare))
            of = rare_shards(block.rare_hash, bits)
            order = np.argsort(of, kind="stable")
            rare_n = (2 * learned + asked)[order].astype("<u8")
            shards = np.arange((1 << bits) + 1)
            edges, rare_edges = np.searchsorted(pairs >> np.uint64(32), shards.astype(np.uint64)).tolist(), np.searchsorted(of[order], shards).tolist()
            order = order.tolist()
            columns: list[list] = [[], [], [], [], [], [], [], []]
            for shard, (lo, hi, a, b) in enumerate(zip(edges, edges[1:], rare_edges, rare_edges[1:])):
                if lo == hi and a == b:
                    continue
                some = slice(begin[lo], begin[hi])
                values = (shard, row["block"], squeezed(np.diff(keys[lo:hi], prepend=0).astype("<u4")), squeezed(meta[lo:hi]), squeezed(words[some]), squeezed(n[some]), joined([rare[i] for i in order[a:b]]), squeezed(rare_n[a:b]))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=["shard", "block", "keys", "meta", "words", "n", "rare", "rare_n"])

    return blocks.mapInArrow(ask, _ASK)


def rare_answers(words: list[list[bytes]], n: list[np.ndarray], speller: Speller | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block's words: the training counts in all blocks; log2 of the spelling, once for each distinct word, of those that its
    training texts have (the word itself left out), and of those that its held-out texts have."""
    coded = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode()
    at, distinct = np.asarray(coded.indices), listed(coded.dictionary)
    flat = np.concatenate(n).astype(np.int64)
    times = np.bincount(at, flat >> 1, len(distinct)).astype("<u8")
    spelled = np.zeros((2, len(distinct)), "<f4")
    if speller:
        for own, used in ((1, flat > 1), (0, (flat & 1) > 0)):
            need = np.flatnonzero(np.bincount(at, used, len(distinct)))
            spelled[own, need] = speller.log2_words([distinct[i] for i in need.tolist()], bool(own))
    out, lo = [], 0
    for one in n:
        here, lo = at[lo : lo + len(one)], lo + len(one)
        out.append((times[here], spelled[1, here[one > 1]], spelled[0, here[(one & np.uint64(1)) > 0]]))
    return out


def answers(asked: DataFrame, model=None) -> DataFrame:
    """Of each shard, for each block: the two commonest followers of the pairs asked about that more than one passage has, and
    what `rare_answers` tells of its rare words."""

    def tell(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(expanded(x.as_py(), "<u4").astype(np.int64)) for x in rows.column("keys")]
        sizes = [len(k) for k in keys]
        all_keys = np.concatenate(keys)
        meta = np.concatenate([expanded(x.as_py(), "u1") for x in rows.column("meta")])
        words = np.concatenate([expanded(x.as_py(), "<u4") for x in rows.column("words")]).astype(np.int64)
        n = np.concatenate([expanded(x.as_py(), "u1") for x in rows.column("n")]).astype(np.int64)
        distinct, at = np.unique(all_keys, return_inverse=True)
        asked_by = np.bincount(at, minlength=len(distinct)) + np.bincount(at, meta >> 7, len(distinct))
        owner = np.repeat(at, meta & 127)
        told = np.sort((owner << 32) | (words << 8) | n)
        cuts = np.flatnonzero(np.diff(told >> 8, prepend=-1))
        total = np.add.reduceat(told & 255, cuts) if len(cuts) else np.zeros(0, np.int64)
        told = told[cuts] >> 8
        ordered = np.sort(((told >> 24) << 39) | ((32767 - np.minimum(total, 32767)) << 24) | (told & ((1 << 24) - 1)))
        owner = ordered >> 39
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        two = np.zeros((4, len(distinct)), np.uint32)
        for k in (0, 1):
            on = nth == k
            two[2 * k, owner[on]] = ordered[on] & ((1 << 24) - 1)
            two[2 * k + 1, owner[on]] = np.minimum(32767 - ((ordered[on] >> 24) & 32767), 255)
        two[:, asked_by < 2] = 0
        two = two[:, at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        part = lambda i, kind: pa.array([squeezed(two[i, a:b].astype(kind)) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        rare = rare_answers([parted(x.as_py()) for x in rows.column("rare")], [expanded(x.as_py(), "<u8") for x in rows.column("rare_n")], model.value if model else None)
        times, own, other = (pa.array([squeezed(r[k]) for r in rare], pa.binary()) for k in range(3))
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "best": part(0, "<u4"), "best_n": part(1, "u1"), "next": part(2, "<u4"), "next_n": part(3, "u1"), "times": times, "spelled_own": own, "spelled": other})

    return asked.groupBy("shard").applyInArrow(lambda rows: tell(rows), _TOLD)


def expected(block: Block, bits: int, told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the word the memory expects at each token or -1, its state or 0), a passage's own training counts left out."""
    _, rank = pairs_of(block, bits)
    words = [told[0][rank].astype(np.int64), told[2][rank].astype(np.int64)]
    counts = [told[1][rank].astype(np.int64), told[3][rank].astype(np.int64)]
    # A pair's answer is the same wherever it stands: its own uses in a passage are those of its tokens there that are what is told.
    at = np.flatnonzero((counts[0] > 0) & ~block.held)
    if len(at):
        key = (block.passage[at] << 32) | rank[at]
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
        sizes = np.diff(new, append=len(key))
        for k in (0, 1):
            counts[k][at] -= np.repeat(np.add.reduceat(block.code[at] == words[k][at], new, dtype=np.int64), sizes) * (counts[k][at] > 0)
    counts = np.maximum(counts, 0)
    first = counts[0] >= counts[1]
    best, other = np.where(first, counts[0], counts[1]), np.where(first, counts[1], counts[0])
    contested = np.where(other == 0, 0, np.where(3 * other < best, 1, 2))
    state = 1 + 3 * np.minimum(4, np.log2(np.maximum(best, 1)).astype(np.int64)) + contested
    return np.where(best > 0, np.where(first, words[0], words[1]), -1).astype(np.int32), np.where(best > 0, state, 0).astype(np.uint8)


@dataclass
class Told:
    """What a block is told: the word expected at each token and the memory's state; of each rare word its training count, and log2 of
    its spelling in training texts and in held-out ones."""

    expect: np.ndarray
    state: np.ndarray
    times: np.ndarray
    spelled: np.ndarray


def told_blocks(blocks: DataFrame, bits: int, sent, model, made: Callable[[pa.Table, dict, Block, Told], pa.Table], schema: str) -> DataFrame:
    """What `made` makes of each block (its row, the same without ids, the block) and of what it is told."""
    told = answers(questions(blocks, bits, sent), model)

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        got = {c: np.concatenate([expanded(x.as_py(), kind) for x in right.column(c)] or [np.zeros(0, kind)]) for c, kind in (("best", "<u4"), ("best_n", "u1"), ("next", "<u4"), ("next_n", "u1"), ("times", "<u8"), ("spelled_own", "<f4"), ("spelled", "<f4"))}
        row = left.drop_columns(["ids"]).to_pylist()[0]
        block, row["rare"] = _block_of(row, sent.value)
        expect, state = expected(block, bits, [got[c] for c in ("best", "best_n", "next", "next_n")]) if len(block.symbols) else (np.zeros(0, np.int32), np.zeros(0, np.uint8))
        order = np.argsort(rare_shards(block.rare_hash, bits), kind="stable")
        times, spelled = np.zeros(len(order), np.int64), np.zeros((2, len(order)))
        times[order] = got["times"]
        learned, asked = rare_uses(block, len(order))
        spelled[1, order[learned[order] > 0]] = got["spelled_own"]
        spelled[0, order[asked[order]]] = got["spelled"]
        return made(left, row, block, Told(expect, state, times, spelled))

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: put(a, b), schema)


def with_memory(blocks: DataFrame, bits: int, sent) -> DataFrame:
    """The blocks with `expect` and `state`, four and one bytes a token."""

    def made(left: pa.Table, row: dict, block: Block, told: Told) -> pa.Table:
        return left.append_column("expect", pa.array([squeezed(told.expect)], pa.binary())).append_column("state", pa.array([squeezed(told.state)], pa.binary()))

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return told_blocks(blocks, bits, sent, None, made, _BLOCK.format(kind=kind) + ", expect binary, state binary")


# Bits of tokens, their inputs and the score.


def earlier(keys: np.ndarray) -> np.ndarray:
    """Of each key, of fewer than 39 bits: how many before it are the same."""
    packed = keys << 24
    packed |= np.arange(len(keys))
    packed.sort()
    order = packed & 0xFFFFFF
    packed >>= 24
    is_new = np.ones(len(packed), bool)
    np.not_equal(packed[1:], packed[:-1], out=is_new[1:])
    starts = np.flatnonzero(is_new)
    n = np.empty(len(keys), np.float32)
    n[order] = np.arange(len(keys), dtype=np.float32) - np.repeat(starts.astype(np.float32), np.diff(starts, append=len(keys)))
    return n


def bit_keys(tokens: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A hash, by its high bits, of each bit's node and what goes for its token."""
    with np.errstate(over="ignore"):
        key = mixed(tokens.astype(np.uint64)).take(owner)
        key ^= nodes.astype(np.uint64) * _SALT[2]
        key *= _MIX
        return key


def leaves(book: Dictionary, symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < 0, len(book.number), symbols)


def paths(book: Dictionary, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, node, bit, and the first bit of each token) of the symbols' paths."""
    leaf = leaves(book, symbols)
    depth = book.depth.take(leaf)
    first = np.cumsum(depth) - depth
    owner = np.repeat(np.arange(len(leaf)), depth)
    at = (book.starts.take(leaf) - first).take(owner)
    at += np.arange(len(at))
    steps = book.steps.take(at)
    return owner, (steps >> 1).astype(np.int64), (steps & 1).astype(np.uint8), first


def last_followers(block: Block, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """(the word that followed the word before when the passage last had it, or -1; 1, or 2 or 3 as it differs from the time before that or not)."""
    code, passage = block.code[some], block.passage[some]
    same = np.zeros(len(code), bool)
    np.equal(passage[1:], passage[:-1], out=same[1:])
    key = np.zeros(len(code), np.int64)
    key[1:] = code[:-1]
    key = np.where(same, key, (1 << 24) + np.arange(len(code))) | (passage - passage[0] << 40)
    order = np.argsort(key, kind="stable")
    k, c = key[order], code[order]
    one, two = np.zeros(len(k), bool), np.zeros(len(k), bool)
    one[1:], two[2:] = k[1:] == k[:-1], k[2:] == k[:-2]
    before, earlier_one = np.full(len(k), -1), np.full(len(k), -1)
    before[1:][one[1:]] = c[:-1][one[1:]]
    earlier_one[2:][two[2:]] = c[:-2][two[2:]]
    guess, trust = np.empty(len(k), np.int32), np.empty(len(k), np.int32)
    guess[order] = before
    trust[order] = one * (1 + two + (two & (before == earlier_one)))
    return guess, trust


def spoken(book: Dictionary, guess: np.ndarray, symbols: np.ndarray, first: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bits where the guessed words' paths agree so far, the token of each, 1.5 or -1.5 for the bit each goes on with)."""
    token = np.flatnonzero(guess >= 0)
    said, true = np.where(guess[token] < RARE_CODE, guess[token], len(book.number)), np.where(symbols[token] < 0, len(book.number), symbols[token])
    # The highest bit in which two paths differ; what could round up to the next power is taken out.
    differ = book.path.take(said) ^ book.path.take(true)
    differ &= ~(differ >> np.uint64(1))
    alike = 64 - np.frexp(differ.astype(float))[1].astype(np.int64)
    agree = np.where(said == true, book.depth.take(true), alike + 1)
    ends = np.cumsum(agree)
    at = np.repeat(first[token] - (ends - agree), agree)
    at += np.arange(len(at))
    says = bits.take(at)
    says[(ends - 1)[said != true]] ^= 1
    return at, np.repeat(token, agree), says * np.float32(3) - np.float32(1.5)


def token_bits(book: Dictionary, table: Slots, block: Block, expect: np.ndarray, state: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, weight of each, gate, bits, token of each bit) of a slice of whole passages."""
    symbols, passage = block.symbols[some], block.passage[some] - block.passage[some.start]
    owner, node, bits, first = paths(book, symbols)
    learned = ~block.held[some].take(owner)
    x, at, gate = np.empty((INPUTS, len(bits)), np.float32), np.empty((INPUTS, len(bits)), np.int64), np.zeros(len(bits), np.int64)
    x[0], level = apart(book.node_look.take(node))
    at[0] = level
    key = (passage * len(book.node_n)).take(owner)
    key += node
    few = np.flatnonzero(learned & (level < LEVELS - 1))  # else one's own are too few to tell
    _, own = np.unique(key.take(few), return_inverse=True)
    n = np.maximum(book.node_n.take(node.take(few)) - np.bincount(own).take(own), 0)
    x[0, few], at[0, few] = _logit(n, np.minimum(np.maximum(book.node_ones.take(node.take(few)) - np.bincount(own, bits.take(few)).take(own), 0), n)), level_of(n)
    slot = (bit_keys(block.after[some], owner, node) >> np.uint64(64 - AFTER_BITS)).view(np.int64)
    x[1], at[1] = table.inputs(slot, (bits + np.uint8(1)) * learned)
    # Of the times that the passage was at a node it went on like now as often as it was where this leads.
    said, alike = earlier(key), np.empty(len(bits), np.float32)
    alike[:-1] = said[1:]
    alike[np.append(first[1:], len(bits)) - 1] = earlier(passage * (len(book.number) + 1) + leaves(book, symbols))
    x[2], at[2] = _logit(said, alike), level_of(said)
    x[2] *= bits * np.float32(2) - np.float32(1)
    x[3:], at[3:] = 0, 0
    guess, trust = last_followers(block, some)
    there, token, says = spoken(book, guess, symbols, first, bits)
    x[3, there], at[3, there] = says, trust.take(token)
    there, token, says = spoken(book, expect[some], symbols, first, bits)
    x[4, there], gate[there] = says, state[some].take(token)
    base = gate * (INPUTS * LEVELS)
    for i in range(INPUTS):
        at[i] += base
        base += LEVELS
    return x, at, gate, bits, owner


def _logit(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (n - ones + np.float32(PRIOR)))


def passages(block: Block) -> Iterator[slice]:
    """Slices of whole passages, of about `UNIT` tokens."""
    starts = np.flatnonzero(np.diff(block.passage, prepend=-1))
    lo = 0
    for end in [*starts[1:].tolist(), len(block.passage)]:
        if end - lo >= UNIT:
            yield slice(lo, end)
            lo = end
    if lo < len(block.passage):
        yield slice(lo, len(block.passage))


def escapes(block: Block, expect: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
    """Of the rare tokens: where they are, whether the memory expects a rare word and whether it's the one, how many rare tokens the passage had before and how many of the word."""
    at = np.flatnonzero(block.symbols < 0)
    guess = expect[at]
    offers = guess >= RARE_CODE
    hit = offers & (guess == block.code[at])
    passage, word = block.passage[at], (-1 - block.symbols[at]).astype(np.int64)
    first = np.searchsorted(passage, passage)
    before = np.arange(len(at)) - first
    order = np.argsort((passage << 32) | word, kind="stable")
    key = ((passage << 32) | word)[order]
    uses = np.empty(len(at), np.int64)
    uses[order] = np.arange(len(at)) - np.searchsorted(key, key)
    return {"at": at, "offers": offers, "hit": hit, "state": state[at].astype(np.int64), "before": before, "uses": uses, "word": word, "size": np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64), 15)}


def escape_counts(e: dict[str, np.ndarray]) -> np.ndarray:
    """How often the memory's rare word was offered and right, by state; how often a rare word could be one of the passage's and was, by their number."""
    offers, asked = e["offers"], ~e["hit"] & (e["before"] > 0)
    count = lambda at, of: np.bincount(e[of][at], minlength=STATES)[:STATES].astype(float)
    return np.concatenate([count(offers & e["hit"], "state"), count(offers, "state"), count(asked & (e["uses"] > 0), "size"), count(asked, "size")])


def escape_log2(e: dict[str, np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of what follows the escape, without the spelling; which tokens are spelled)."""
    right, offered, used, asked = counts.reshape(4, STATES)
    p = ((right + 0.5) / (offered + 1))[e["state"]]
    out = np.where(e["offers"], np.log2(np.where(e["hit"], p, 1 - p)), 0.0)
    p = ((used + 0.5) / (asked + 1))[e["size"]]
    again = (e["before"] > 0) & ~e["hit"]
    known = again & (e["uses"] > 0)
    out += np.where(again, np.log2(np.where(known, p * np.maximum(e["uses"], 1) / np.maximum(e["before"], 1), 1 - p)), 0.0)
    return out, ~e["hit"] & ~known


def after_table(blocks: DataFrame, n_blocks: int, sent) -> Slots:
    """The table of bits after words before, over all training passages: a task adds up its own in a table of fixed size."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 << AFTER_BITS, np.int32)
        held: list[np.ndarray] = []

        def flush() -> None:
            # A word after a word is looked up once, however often these blocks have it; by words, whose paths then lie side by side.
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for lo in range(0, len(pairs), UNIT):
                some = slice(lo, lo + UNIT)
                owner, node, bits, _ = paths(sent.value, (pairs[some] >> 32) - 1)
                slot = (bit_keys(pairs[some] & ((1 << 32) - 1), owner, node) >> np.uint64(64 - AFTER_BITS)).view(np.int64)
                np.add.at(both, 2 * slot + bits, times[some].astype(np.int32).take(owner))

        for row in _rows(batches):
            sizes, symbols = np.array(row["sizes"], np.int64), expanded(row["symbols"], "<i4")
            before = words_before(np.cumsum(sizes) - sizes, symbols, parted(row["rare"]), sent.value)
            pairs = (np.maximum(symbols, -1).astype(np.int64) + 1 << 32) | before
            held.append(pairs[~np.repeat(np.array(row["held"], bool), sizes)])
            if sum(map(len, held)) > PAIRS:
                flush()
        if held:
            flush()
        yield from _table_parts(both[::2], both[1::2], PARTS)

    return quantized_table(blocks.mapInArrow(add_up, "part int, raw binary"), n_blocks, 1 << AFTER_BITS, PARTS)


def score_block(row: dict, block: Block, told: Told, book: Dictionary, table: Slots, new: float, n_rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of each text, its number of known tokens, their base log10 together and that of the others).

    The mixer starts anew in each block: it scores a step of bits, then learns from those of training texts. `new`: the share of
    words met once among the `n_rare` uses of words outside the dictionary.
    """
    docs = len(row["sizes"])
    log2, mixer, counts = np.zeros(docs), Mixer.blank(STATES, INPUTS), np.zeros(4 * STATES)
    squares = np.full(len(mixer.weights), 1e-6)
    e = escapes(block, told.expect, told.state)
    far = np.zeros(len(e["at"]), bool)
    lo = 0
    for some in passages(block):
        x, at, gate, bits, owner = token_bits(book, table, block, told.expect, told.state, some)
        got = mixer.learn(x, at, gate, bits, squares, ~block.held[some].take(owner))
        doc = block.doc[some]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        log2[doc[starts]] += np.add.reduceat(got, np.searchsorted(owner, starts), dtype=float)
        hi = int(np.searchsorted(e["at"], some.stop))
        now = {k: v[lo:hi] for k, v in e.items()}
        got, far[lo:hi] = escape_log2(now, counts)
        log2 += np.bincount(block.doc[now["at"]], got, docs)
        learned = ~block.held[now["at"]]
        counts += escape_counts({k: v[learned] for k, v in now.items()})
        lo = hi
    doc = block.doc[e["at"]]
    known = block.symbols >= 0
    base, n_known = np.bincount(block.doc[known], book.log10_n[block.symbols[known]], docs), np.bincount(block.doc[known], minlength=docs)
    # Distinct rare words of a text: how often, and how often spelled.
    pairs, at = np.unique((doc << 32) | e["word"], return_inverse=True)
    n, n_far = np.bincount(at, minlength=len(pairs)), np.bincount(at, far, len(pairs))
    of, word = pairs >> 32, pairs & ((1 << 32) - 1)
    times, held = told.times[word], np.array(row["held"], bool)[of]
    base += np.bincount(of, n * np.log10(times + 0.5), docs)
    n_known += np.bincount(of, np.where(times > 0, n, 0), docs).astype(np.int64)
    # A rare word is one of the corpus, by its count without the text's own, or spelled: the share of the latter is that of words met once.
    from_count = np.maximum(times - np.where(held, 0, n), 0) * ((1 - new) / max(1, n_rare))
    spelled = told.spelled[np.where(held, 0, 1), word] * math.log10(2)
    p = np.where(from_count > 0, np.log10(np.where(from_count > 0, from_count + new * 10.0 ** np.maximum(spelled, -300.0), 1.0)), spelled + math.log10(new))
    return log2 * math.log10(2) + np.bincount(of, n_far * p, docs), n_known, base


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", top_words: int = TOP_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), is_held_out(id_column).alias("held_out"))
    counts = written(word_counts(rows.filter(~F.col("held_out"))))
    n_train, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    is_end = F.col("word") == F.lit(END)
    common = counts.filter((F.col("n") >= min_count) & ~is_end).orderBy(F.desc("n"), "word").limit(top_words).toPandas()
    words, times = [END, *map(bytes, common["word"])], [sum(r[0] for r in counts.filter(is_end).select("n").collect()), *common["n"].tolist()]
    book = dictionary_of(words, times, n_train - sum(times))
    sent = spark.sparkContext.broadcast(book)
    in_book = is_end if len(words) == 1 else is_end | (F.col("n") > times[-1]) | ((F.col("n") == times[-1]) & (F.col("word") <= F.lit(words[-1])))
    rare = written(counts.filter(~in_book))
    n_rare, n_rare_words, n_single = rare.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1))).first()
    speller = learn_spelling(rare, n_rare_words, byte_code(words))

    bare = written(blocks_of(rows, sent))
    n_blocks, n_tokens = bare.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    table = spark.sparkContext.broadcast(after_table(bare, n_blocks, sent))
    model = spark.sparkContext.broadcast(speller)
    new = (n_single + 1) / (n_rare + 1)

    def score(left: pa.Table, row: dict, block: Block, told: Told) -> pa.Table:
        log10, n_known, base = score_block(row, block, told, sent.value, table.value, new, n_rare)
        return pa.table({"doc_id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base), "score": pa.array(log10), "n_bytes": pa.array(row["n_bytes"], pa.int64())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    sums = told_blocks(bare, shard_bits(n_tokens), sent, model, score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint")
    bound = math.log10(n_train + 0.5 * (n_distinct + 1))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(bound)).alias("base_score"),
        "score",
        "n_bytes",
        (F.col("score") * (-math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
