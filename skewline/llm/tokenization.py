"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are taken in batches balanced by bytes. A text longer than `split_bytes` is cut at ASCII white space, where the
tokenizer's own pre-tokenizer cuts too, so no token can span the cut; a text without such a place stays whole. Within a
batch every distinct white-space chunk is encoded once, by the library, and the parts of words are remembered by the
Python worker in a bounded cache; splitting, finding distinct chunks and adding up are vectorised.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted once
each; an empty table gives an empty table; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MAX_TOKENS = 2048
BATCH_BYTES = 6 << 20
SPLIT_BYTES = 1 << 16
#: Parts of words remembered by one Python worker; some 200 bytes each.
CACHE_PARTS = 400_000
#: Longer chunks go to the library whole and are not remembered.
CACHE_PART_BYTES = 96

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ENCODERS: dict[str, ChunkEncoder] = {}


def vocabulary_path(name: str) -> str:
    """A vocabulary file by path, or by name among the installed public tokenizers (resolved where it is used)."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


class ChunkEncoder:
    """Encodes UTF-8 texts as little-endian unsigned 32-bit ids, through the library that the vocabulary is made for."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(vocabulary)
        self.parts: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_many = lambda texts: library.encode(texts, num_threads=1)
            self.by_chunk = self.plain = False
        else:
            import tokenizers

            library = tokenizers.Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode_many = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            # White space separates for certain only where the pre-tokenizer drops it.
            probe = ["a b", "a", "b", "a \n\tb"]
            one, a, b, two = self.encode_many(probe)
            self.by_chunk = one == a + b == two
            self.plain = self.by_chunk and self._plain_words(library)

    def _plain_words(self, library):
        """The library with the same merges for parts that are lower-cased and cut already, many to a call, and for each id
        whether it ends a part. Holds for letters up to U+017F if the library itself says so on a probe; else None, and
        all chunks go to the library as they are.
        """
        import tokenizers

        model = json.loads(library.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not suffix:
            return None
        bare = tokenizers.Tokenizer.from_str(library.to_str())
        bare.normalizer = tokenizers.normalizers.Sequence([])
        bare.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(library.get_vocab_size(), bool)
        ends[[i for token, i in library.get_vocab().items() if token.endswith(suffix)]] = True
        probe = ["The", "zurück", "éÀñß", "xqzjk", "Internationalization", "a", "ÿ", "ł", ",", "12", "?!", "ab,cd12?!x"]
        self.bare, self.ends = bare, ends
        parts = [re.findall(_PARTS, p.lower()) for p in probe]
        got = [b"".join(self._encode_parts(p)) for p in parts]
        return True if got == [pack_ids(x) for x in self.encode_many(probe)] else None

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, from library calls on many parts joined by spaces; an id that ends a part tells where to cut."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 65536):
            some = parts[lo : lo + 65536]
            lines = [" ".join(some[i : i + 512]) for i in range(0, len(some), 512)]
            ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            assert len(cuts) == len(some), "a part has no end"
            raw, at = ids.tobytes(), 0
            for cut in cuts.tolist():
                out.append(raw[at:cut])
                at = cut
        return out

    def _of_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, end to end, and each chunk's number of ids."""
        if not self.plain:
            plain = pa.array([False] * len(chunks))
        else:
            plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.less_equal(pc.binary_length(chunks), CACHE_PART_BYTES))
        marks = np.asarray(plain.to_numpy(zero_copy_only=False), dtype=bool)
        easy, hard = chunks.filter(plain), chunks.filter(pc.invert(plain))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(easy), _PARTS, r"\1 "))
        coded = lists.flatten().dictionary_encode()
        pool = self._of_parts(coded.dictionary.to_pylist())
        ids, n = gather(pool, coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))
        if not len(hard):
            return ids, n
        there = [pack_ids(x) for x in self.encode_many(hard.to_pylist())]
        lengths = np.zeros(len(chunks), np.int64)
        lengths[marks], lengths[~marks] = n, [len(x) // 4 for x in there]
        out, starts = np.empty(lengths.sum(), "<u4"), np.cumsum(lengths) - lengths
        out[spread(starts[marks], n)] = ids
        out[spread(starts[~marks], lengths[~marks])] = np.frombuffer(b"".join(there), "<u4")
        return out, lengths

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        cache = self.parts
        if len(cache) > CACHE_PARTS:
            cache.clear()
        cache[""] = b""
        pool = list(map(cache.get, parts))
        missing = [p for p, ids in zip(parts, pool, strict=True) if ids is None]
        if missing:
            cache.update(zip(missing, self._encode_parts(missing), strict=True))
            pool = list(map(cache.__getitem__, parts))
        return pool

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and each text's number of ids; the batch shares one pass over its distinct chunks."""
        if not self.by_chunk:
            got = self.encode_many([t.decode("utf-8", "replace") for t in texts])
            return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        ids, n = self._of_chunks(coded.dictionary)
        return gather((ids, n), coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Numbers of ids only: the ids of distinct chunks are counted, never laid out by text."""
        if not self.by_chunk:
            return [len(x) for x in self.encode_many([t.decode("utf-8", "replace") for t in texts])]
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        n = self._of_chunks(coded.dictionary)[1]
        return sums(n[coded.indices.to_numpy()], np.diff(lists.offsets.to_numpy())).tolist()


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def gather(pool, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lay out the pool's entries which[0], which[1], ...; counts[i] of them form item i. Gives ids and ids an item."""
    if isinstance(pool, list):
        n = np.array([len(x) // 4 for x in pool], np.int64)
        flat = np.frombuffer(b"".join(pool), "<u4")
    else:
        flat, n = pool
    lengths = n[which]
    return flat[spread((np.cumsum(n) - n)[which], lengths)], sums(lengths, counts)


#: Letters up to U+017E, digits and ASCII marks: lower case is one letter of the same range, other normal forms change
#: nothing. No apostrophe (contractions) and no `<` (special strings): chunks with those go to the library whole.
_PLAIN = r"""^[a-zA-Z0-9!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~À-ÖØ-öø-įıĲ-ž]*$"""
_PARTS = r"""([a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+)"""


def pack_ids(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder in each Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def split_long(text: bytes, most: int) -> list[bytes]:
    """Cut at the first ASCII white space at or after every `most` bytes; what has none stays whole."""
    out, lo = [], 0
    while len(text) - lo > most:
        m = _SPACE.search(text, lo + most)
        if not m:
            break
        out.append(text[lo : m.start()])
        lo = m.start()
    out.append(text[lo:] if lo else text)
    return out


def balanced(texts: list[bytes], batch_bytes: int, split_bytes: int, can_split: bool) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of (text number, part) with about `batch_bytes` each."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for p in split_long(t, split_bytes) if can_split and len(t) > split_bytes else (t,):
            rows.append(i)
            parts.append(p)
            size += len(p)
            if size >= batch_bytes:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def texts_of(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = BATCH_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(id, n_bytes long, n_tokens long) for each row. No shuffle; texts enter Python, only numbers leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = [0] * len(texts)
            for rows, parts in balanced(texts, batch_bytes, split_bytes, enc.by_chunk):
                for i, k in zip(rows, enc.lengths(parts), strict=True):
                    n[i] += k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(count, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")
