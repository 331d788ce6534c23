"""Token ids in files: a wavelet matrix per shard, whose bit-planes give access, counts and occurrences from one compressed file.

A file holds the ids of whole documents in ascending order of their ids. Plane l has, in the order left by the planes before,
the l-th highest bit of each id; the next plane has those with bit 0 first, then those with bit 1, each in their order. Planes
are cut into blocks of 65,536 bits, compressed one by one, with the number of ones before each block: rank reads one block a
plane, select searches the counts and reads one block, so an id, the number of times one occurs in a stretch, or its k-th place
take a block a plane, and a whole file is decoded plane by plane from the last to the first.

File format, little-endian: `SKWMAT01`, unsigned 32-bit length of the header, header (JSON: tokens, bits, zeros of each plane,
sizes of all blocks by plane, ones before each block by plane, size of the document table), document table (Arrow IPC stream,
zstd: id, n_tokens), blocks (zstd, or as they are where that is not smaller).

Shards are ranges of document ids, sorted by id, then by the MD5 of the text; a file is closed at `shard_tokens`, so neither
a hot id nor long texts make a file or a task's memory grow, save that one document is never cut. Files are written under a draft name
and renamed, with names told by place, so a task that runs again writes the same. The folder may be any that pyarrow opens.

Defined results: a null text is empty and has the end id only; null ids come first and stay null; rows with the same id and text are
interchangeable; an empty table gives no file and an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, text_or_empty, written
from .tokenization import spread, vocabulary_path

MAGIC = b"SKWMAT01"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 23
SHARD_BYTES = 1 << 25
BATCH_BYTES = 16 << 20
END_ID = 2

#: A part of a text is ASCII white space and what follows it up to the next; a byte-level pre-tokenizer cuts there, unless the
#: part before ends with other white space. Bytes of ASCII white space by number.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = r"^ ?[^\x20\x09-\x0D]+$"
_OTHER_SPACE = r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PARTS_A_LINE = 512
#: Runs that the pre-tokenizer keeps together, of letters up to U+017E, digits and ASCII marks without the apostrophe.
_RUN = r"( ?[A-Za-zÀ-ÖØ-öø-ž]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n)"
_OF_RUNS = r"^ ?[A-Za-zÀ-ÖØ-öø-ž0-9!-&(-/:-@\[-`{-~]+$"
_CUT = "\x01"
#: Parts remembered by one Python worker, some 200 bytes each.
CACHE_PARTS = 700_000


def in_signs(lines: pa.StringArray, table: np.ndarray) -> list[str]:
    """Lines cut into runs, each byte written as one character."""
    cut = pc.replace_substring_regex(lines, _RUN, r"\1" + _CUT)
    at = np.frombuffer(cut.buffers()[1], np.int32)[cut.offset : cut.offset + len(cut) + 1].tolist()
    text = table[np.frombuffer(cut.buffers()[2] or b"", np.uint8)[: at[-1]]].tobytes().decode("utf-16-le")
    return [text[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def laid_out(flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries which[0], which[1], ... of a pool, end to end, and the number of ids before each and in all; in 32-bit numbers."""
    n = n.astype(np.int32)
    lengths = n[which]
    upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)))
    at = np.repeat((np.cumsum(n, dtype=np.int32) - n)[which] - upto[:-1], lengths)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], upto


class ByteEncoder:
    """Texts as ids, by the tokenizers library. Texts are cut into parts, and each distinct part is encoded once: many at a
    time, with line ends between, whose id tells them apart; a bounded number is remembered. Texts with white space that isn't ASCII are encoded whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(vocabulary_path(vocabulary))
        self.library.no_truncation()
        self.library.no_padding()
        top = max(self.library.get_vocab(with_added_tokens=True).values())
        self.bits = max(1, top.bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        told = json.loads(self.library.to_str())
        pre = told["pre_tokenizer"] or {}
        self.parts: dict[bytes, bytes] = {}
        self.special = [t["content"] for t in told["added_tokens"]]
        line = self._whole(["\n", "a", " bc", "(d", "a\n bc\n(d\n"])
        self.line = int(line[0][0])
        by_line = len(line[0]) == 1 and line[4].tolist() == [i for x in line[1:4] for i in (*x, self.line)]
        self.bare = self._bare()
        self.by_part = by_line and told["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for lo in range(0, len(texts), 8192) for e in self.library.encode_batch_fast(texts[lo : lo + 8192], add_special_tokens=False)]

    def _of_parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, end to end, and each part's number of ids."""
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].tolist()
        text, size = (parts.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), self.kind.itemsize
        names = [text[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
        got = list(map(self.parts.get, names))
        new = [i for i, x in enumerate(got) if x is None]
        ids, n = self._of_new(parts.take(pa.array(new, pa.int64())))
        raw, lo = ids.tobytes(), 0
        for i, hi in zip(new, (np.cumsum(n) * size).tolist(), strict=True):
            self.parts[names[i]] = got[i] = raw[lo:hi]
            lo = hi
        return np.frombuffer(b"".join(got), self.kind), np.fromiter(map(len, got), np.int64, len(got)) // size

    def _bare(self) -> tuple[object, np.ndarray] | None:
        """The library with the same merges for runs that are cut and written in its own signs for bytes, and the sign of each byte;
        None if that gives other ids on a probe."""
        import tokenizers

        signs = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = np.arange(256, dtype="<u2")
        for c in [" ", "\n", *map(chr, range(0xC0, 0x17F))]:
            table[list(c.encode())] = [ord(x) for x in signs.pre_tokenize_str(c)[0][0]]
        table[ord(_CUT)] = ord(" ")
        bare = tokenizers.Tokenizer.from_str(self.library.to_str())
        bare.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        probe = "\n".join(["The", " quick", " zurück,%%%", " 12ab", "éÀñß", " ł", " Ġ", " Ċ", " (x)[3]{y}~`_", "Internationalization", " 0.5%", " #1!?", " xqzjk,éé--1234567", "a"])
        same = bare.encode(in_signs(pa.array([probe]), table)[0], add_special_tokens=False).ids == self._whole([probe])[0].tolist()
        return (bare, table) if same else None

    def _lines(self, parts: pa.StringArray, of_runs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without line ends, from calls for many at once."""
        cuts = np.append(np.arange(0, len(parts), PARTS_A_LINE), len(parts)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), parts), "\n")
        if of_runs and self.bare:
            bare, table = self.bare
            got = [e.ids for e in bare.encode_batch_fast(in_signs(lines, table), add_special_tokens=False)]
        else:
            got = self._whole(lines.to_pylist())
        flat = np.concatenate([np.append(x, self.line).astype(self.kind) for x in got]) if got else np.zeros(0, self.kind)
        ends = np.flatnonzero(flat == self.line)
        if len(ends) != len(parts):
            raise ValueError("the vocabulary takes line ends into other ids")
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _of_new(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that aren't remembered."""
        plain = pc.match_substring_regex(parts, _PLAIN)
        for text in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(parts, text)))
        runs = pc.and_(plain, pc.match_substring_regex(parts, _OF_RUNS)) if self.bare else pa.array([False] * len(parts))
        hard = self._whole(parts.filter(pc.invert(plain)).to_pylist())
        kinds = [
            (runs, *self._lines(parts.filter(runs), True)),
            (pc.and_not(plain, runs), *self._lines(parts.filter(pc.and_not(plain, runs)), False)),
            (pc.invert(plain), np.concatenate([np.zeros(0, self.kind), *hard]), np.array([len(x) for x in hard], np.int64)),
        ]
        n = np.empty(len(parts), np.int64)
        for which, _, lengths in kinds:
            n[which.to_numpy(zero_copy_only=False)] = lengths
        out, starts = np.empty(n.sum(), self.kind), np.cumsum(n) - n
        for which, ids, lengths in kinds:
            out[spread(starts[which.to_numpy(zero_copy_only=False)], lengths)] = ids
        return out, n

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and each text's number of ids."""
        if not self.by_part:
            whole = self._whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, self.kind), *whole]), np.array([len(x) for x in whole], np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]
        ends = offsets[1:] - first
        sizes = np.diff(offsets)
        space = _SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(begins).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy()
        upto = np.searchsorted(at, ends)
        ids, before = laid_out(*self._of_parts(coded.dictionary), which)
        n = np.diff(before[upto], prepend=np.int32(0)).astype(np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(coded.dictionary, _OTHER_SPACE).to_numpy(zero_copy_only=False))
        if len(odd):
            rows = np.unique(np.searchsorted(upto, np.flatnonzero(np.isin(which, odd)), side="right"))
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for i, x in zip(rows.tolist(), self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
                pieces[i], n[i] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, n


@lru_cache(maxsize=2)
def byte_encoder(vocabulary: str) -> ByteEncoder:
    """One encoder in each Python worker."""
    return ByteEncoder(vocabulary)


def encode_file(ids: np.ndarray, documents: pa.Table, bits: int) -> bytes:
    """A file of the ids of documents, end to end; `documents`: (id, n_tokens) in order."""
    squeeze = zstandard.ZstdCompressor(level=3)
    zeros, sizes, ones, blocks = [], [], [], []
    for level in range(bits):
        plane = (ids & ids.dtype.type(1 << (bits - 1 - level))).astype(bool)
        packed = np.packbits(plane, bitorder="little")
        counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK_BITS // 8))).reshape(-1, BLOCK_BITS // 8)).sum(1, dtype=np.int64)
        raw = [packed[lo : lo + BLOCK_BITS // 8].tobytes() for lo in range(0, len(packed), BLOCK_BITS // 8)]
        small = [min(b, squeeze.compress(b), key=len) for b in raw]
        zeros.append(int(len(ids) - counts.sum()))
        ones.append((np.cumsum(counts) - counts).tolist())
        sizes.append([len(b) for b in small])
        blocks.extend(small)
        ids = np.concatenate((ids[~plane], ids[plane]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    table = sink.getvalue().to_pybytes()
    header = json.dumps({"tokens": len(ids), "bits": bits, "zeros": zeros, "sizes": sizes, "ones": ones, "documents": len(table)}, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, table, *blocks])


class WaveletFile:
    """One file's content: documents, ids by place, counts, places."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC) + 4
        size = int.from_bytes(content[len(MAGIC) : at], "little")
        head = json.loads(content[at : at + size])
        at += size
        self.tokens, self.bits, self.zeros = head["tokens"], head["bits"], head["zeros"]
        self.documents = pa.ipc.open_stream(content[at : at + head["documents"]]).read_all()
        at += head["documents"]
        ends = at + np.cumsum([s for plane in head["sizes"] for s in plane], dtype=np.int64)
        if len(content) != (ends[-1] if len(ends) else at):
            raise ValueError("the file of token ids is cut off")
        per = len(head["sizes"][0]) if head["sizes"] else 0
        self._content, self._per = content, per
        self._starts = np.concatenate(([at], ends))
        self._ones = [np.array(x, np.int64) for x in head["ones"]]
        self._block = lru_cache(maxsize=512)(self._read)

    def _read(self, level: int, block: int) -> np.ndarray:
        """A block's bits, a byte each."""
        k = level * self._per + block
        raw = self._content[self._starts[k] : self._starts[k + 1]]
        n = min(BLOCK_BITS, self.tokens - block * BLOCK_BITS)
        if len(raw) != -(-n // 8):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=BLOCK_BITS // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little")

    def _rank(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.tokens:
            return self.tokens - self.zeros[level]
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._ones[level][block]) + int(np.count_nonzero(self._block(level, block)[:rest]))

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0, ascending) ones or zeros of a plane."""
        before = self._ones[level] if bit else np.arange(len(self._ones[level])) * BLOCK_BITS - self._ones[level]
        blocks = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(blocks).tolist():
            mine = blocks == b
            out[mine] = b * BLOCK_BITS + np.flatnonzero(self._block(level, b) == bit)[k[mine] - before[b]]
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the id's occurrences among places lo to before hi stand behind the last plane."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among places lo to before hi."""
        hi = self.tokens if hi is None else min(hi, self.tokens)
        a, b = self._range(token, min(lo, hi), hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of an id, ascending, among places lo to before hi."""
        hi = self.tokens if hi is None else min(hi, self.tokens)
        a, b = self._range(token, min(lo, hi), hi)
        at = np.arange(a, b)
        for level in reversed(range(self.bits) if b > a else ()):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number k, from 0."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = np.array([a + k])
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return int(at[0])

    def ids(self) -> np.ndarray:
        """All ids in order: each plane, from the last, puts what follows it back into its own order."""
        out = np.zeros(self.tokens, "<u2" if self.bits <= 16 else "<u4")
        for level in reversed(range(self.bits)):
            plane = np.concatenate([self._read(level, b) for b in range(self._per)]).astype(bool) if self._per else np.zeros(0, bool)
            back = np.empty_like(out)
            back[~plane] = out[: self.zeros[level]]
            back[plane] = out[self.zeros[level] :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = back
        return out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def publish(path: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    system, place = opened(path)
    draft = f"{place}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, place)


def read_file(path: str) -> WaveletFile:
    system, place = opened(path)
    with system.open_input_stream(place) as f:
        return WaveletFile(f.read())


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    shard_bytes: int = SHARD_BYTES,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Encode all texts, each with `end_id` behind it, into files under `path`; the list of files (part, seq, path, n_docs, n_tokens).

    One shuffle, of ids and texts by ranges; a range is sorted by Spark and encoded as it streams through its task.
    """
    spark = docs.sparkSession
    path = (path or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    system, place = opened(path)
    system.create_dir(place, recursive=True)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = ["id", "_tie", "_row"]
    keyed = rows.withColumns({"_tie": F.md5(F.col("text").cast("binary")), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(max(1, math.ceil(size / shard_bytes)), *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        open_: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            table = pa.table({"id": pa.chunked_array([x[0] for x in open_]), "n_tokens": pa.array(np.concatenate([x[1] for x in open_]))})
            name = f"{path}/tokens-{part:08d}-{seq:06d}.wm"
            publish(name, encode_file(np.concatenate([x[2] for x in open_]), table.combine_chunks(), encoder.bits))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name, "n_docs": len(table), "n_tokens": held}], schema=_FILES)
            open_.clear()
            held, seq = 0, seq + 1
            return row

        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.string())
            size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            lo = 0
            for hi in [*(np.flatnonzero(np.diff(size // batch_bytes)) + 1).tolist(), len(batch)]:
                ids, n = encoder(texts.slice(lo, hi - lo))
                ends = np.cumsum(n + 1)
                ids = np.insert(ids, ends - np.arange(1, len(n) + 1), encoder.kind.type(end_id))
                at = 0  # documents of the slice that are dealt
                while at < len(n):
                    before = int(ends[at - 1]) if at else 0
                    to = max(int(np.searchsorted(ends, before + shard_tokens - held, side="right")), at + (not held))
                    if to > at:
                        # copies, so that the batch's texts don't stay
                        open_.append((pa.array(names.slice(lo + at, to - at).to_pylist(), names.type), n[at:to] + 1, ids[before : ends[to - 1]].copy()))
                        held += int(ends[to - 1]) - before
                    if to < len(n):
                        yield close()
                    at = to
                lo = hi
        if open_:
            yield close()

    return written(dealt.mapInArrow(write, "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint"))


_FILES = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def with_starts(files: DataFrame) -> DataFrame:
    """Adds `start`, the ids in all files before: parts are summed first, then the files of a part."""
    before = lambda *by: Window.partitionBy(*by) if by else Window
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    own = F.sum("n_tokens").over(before("part").orderBy("seq")) - F.col("n_tokens")
    return files.withColumn("_own", own).join(parts, "part").withColumn("start", F.col("_base") + F.col("_own")).drop("_own", "_base")


def read_documents(files: DataFrame, id_kind: str = "bigint", id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary: little-endian unsigned 32-bit) of every document in the files, a file a task at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = read_file(row["path"])
                n = shard.documents["n_tokens"].to_numpy()
                ends = np.cumsum(n)
                raw = shard.ids().astype("<u4").tobytes()
                keys = shard.documents["id"].combine_chunks()
                for lo in range(0, len(n), 2048):
                    some = slice(lo, lo + 2048)
                    ids = [raw[(e - k) * 4 : e * 4] for e, k in zip(ends[some].tolist(), n[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys[some], pa.array(row["start"] + ends[some] - n[some]), pa.array(n[some]), pa.array(ids, pa.binary())], names=[id_column, "start", "n_tokens", "ids"])

    spread = with_starts(files).select("path", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(read, f"`{id_column}` {id_kind}, start bigint, n_tokens bigint, ids binary")


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, place) of each occurrence of a few ids over all files, places counted through the files in order; no file is decoded."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = read_file(row["path"])
                for token in tokens:
                    at = shard.occurrences(token) + row["start"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(at)], names=["token", "place"])

    spread = with_starts(files).select("path", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(look, "token bigint, place bigint")
