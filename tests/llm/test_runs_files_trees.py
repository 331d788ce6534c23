"""Periodic runs, token files and Merkle manifests against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skewline.llm import merkle, periodic_runs, queries, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


# Periodic runs


def runs_by_force(words, min_words=24, min_exponent=3):
    """Every stretch that holds a lag, kept if no smaller lag holds on it."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_exponent * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_force(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive_texts():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a\x0b" * 400, ("a " * 40 + "b ") * 9, " ".join("abc"[i % 3] for i in range(71)), "x y " * 12 + "z " * 30 + "x y z " * 20]
    for size in (40, 90, 200, 333):
        for letters in ("ab", "abcd", "abcdefghij"):
            words = [rng.choice(letters) for _ in range(size)]
            at, q = rng.randrange(size), rng.randint(1, 12)
            words[at:at] = [rng.choice(letters) for _ in range(q)] * rng.randint(2, 9) + words[at : at + 3]
            texts.append(" ".join(words))
    line = " ".join(f"w{i}" for i in range(50))
    texts += ["\n".join([line] * 5), "\n".join([line] * 2), line + " é é é" * 9 + "   " * 9, " ".join("ab"[bin(i).count("1") % 2] for i in range(300))]
    return texts + [texts[7]] * 2


@pytest.fixture(scope="module")
def repetitive(spark):
    rows = [(i, t, "x") for i, t in enumerate(repetitive_texts())] + [(None, "q " * 30, "x"), (3, "one", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)


@pytest.mark.parametrize("min_words, min_exponent", [(24, 3), (4, 2), (1, 5)])
@pytest.mark.parametrize("long_bytes, lags", [(periodic_runs.LONG_BYTES, periodic_runs.LAGS), (60, 7)])
def test_runs_equal_force(repetitive, min_words, min_exponent, long_bytes, lags):
    got = periodic_runs.periodic_runs(repetitive, min_words=min_words, min_exponent=min_exponent, long_bytes=long_bytes, lags=lags, batch_bytes=900)
    want = []
    for r in repetitive.collect():
        words = WORD.findall(r.text or "")
        runs = runs_by_force(words, min_words, min_exponent)
        want.append((r.doc_id, [tuple(x) for x in runs], collapsed_by_force(words, runs)))
    have = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert any(len(x[1]) > 2 for x in want)


def test_run_of_one_word_is_scanned_in_time():
    n = 60_000
    ids = np.append(np.zeros(n, np.int32), np.int32(-1))
    assert periodic_runs.scan(ids, np.array([n])) == [(0, n, 1)]
    again = periodic_runs.scan(ids, np.array([n]), first=5000, last=5100)
    assert again == [(0, n, 1)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_query_equals_force(spark, tmp_path):
    texts = [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 1500 ORDER BY doc_id LIMIT 250").fetchall()]
    texts += [(10_000 + i, t) for i, t in enumerate(repetitive_texts())] + [(None, "a " * 60), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = [], 0
    for doc_id, text in texts:
        original = WORD.findall(text or "")
        words = planted(doc_id, original)
        changed += words != original
        runs = runs_by_force(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed_by_force(words, runs).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert changed > 5 and sorted(got, key=str) == sorted(want, key=str)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


# Token files


def library():
    import tokenizers

    from skewline.llm.tokenization import vocabulary_path

    return tokenizers.Tokenizer.from_file(vocabulary_path(queries.BYTE_VOCABULARY))


ODD_TEXTS = [None, "", " ", "\n\n", "a  b", "a \n b", "don't  won't", "x <|endoftext|> y", "  <|endoftext|>", "a  b", "a   b   c   d", "a\x1c b!\x1c  c", "x\x85 y", "tab\t\tend \t", "日本 語", "é é", "z" * 3000, "…" * 70 + " x", "　 a　", "﻿ b", "᠎ c", "1 22 333", "#", "a\x0b\x0cb"]


def test_byte_encoder_equals_the_library():
    tok = library()
    texts = [t or "" for t in ODD_TEXTS] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 400").fetchall()]
    encode = wavelet.ByteEncoder(queries.BYTE_VOCABULARY)
    for _ in range(2):
        ids, n = encode(pa.array(["skipped", *texts])[1:])
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n, bits", [(0, 4), (1, 1), (5, 3), (70_000, 5), (200_000, 16)])
def test_wavelet_matrix_equals_arrays(n, bits):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % (1 << bits)).astype("<u2")
    documents = pa.table({"id": pa.array([None, "b"], pa.string()), "n_tokens": pa.array([n, 0])})
    file = wavelet.WaveletFile(wavelet.encode_file(ids, documents, bits))
    assert file.documents.equals(documents) and (file.ids() == ids).all()
    for i in rng.integers(0, n, 25 if n else 0).tolist():
        assert file.access(i) == ids[i]
    for token in {*ids[:5].tolist(), 0, (1 << bits) - 1, 1 << bits}:
        at = np.flatnonzero(ids == token)
        assert file.count(token) == len(at) and (file.occurrences(token) == at).all()
        lo, hi = n // 3, 2 * n // 3
        assert file.count(token, lo, hi) == ((at >= lo) & (at < hi)).sum()
        assert (file.occurrences(token, lo, hi) == at[(at >= lo) & (at < hi)]).all()
        for k in range(0, len(at), max(1, len(at) // 7)):
            assert file.select(token, k) == at[k]
        with pytest.raises(IndexError):
            file.select(token, len(at))


def test_cut_off_files_are_refused():
    content = wavelet.encode_file(np.arange(9, dtype="<u2"), pa.table({"id": [1], "n_tokens": [9]}), 4)
    for bad in (content[:-1], b"x" + content[1:]):
        with pytest.raises(ValueError):
            wavelet.WaveletFile(bad)


@pytest.mark.parametrize("shard_tokens, shard_bytes", [(wavelet.SHARD_TOKENS, wavelet.SHARD_BYTES), (40, 700), (1, 1 << 20)])
def test_token_files_round_trip(spark, tmp_path, shard_tokens, shard_bytes):
    rows = [(i % 17 - 3, t, "n") for i, t in enumerate(ODD_TEXTS)] + [(None, "orphan", "n"), (4, "twice", "n"), (4, "twice", "n"), (4, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    files = wavelet.write_tokens(docs, queries.BYTE_VOCABULARY, str(tmp_path), shard_tokens=shard_tokens, shard_bytes=shard_bytes, batch_bytes=shard_bytes // 3)
    tok, want, start = library(), [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    for doc_id, text, _ in ordered:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = wavelet.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    told = files.collect()
    assert sum(f.n_tokens for f in told) == start and sorted(f.path for f in told) == sorted(str(p) for p in tmp_path.iterdir())
    if shard_tokens == 40:
        assert len(told) > 5
    ends = [r[1] + r[2] - 1 for r in want]
    places = sorted(r.place for r in wavelet.occurrences(files, [2]).collect())
    assert set(ends) <= set(places) and len(places) == len(ends) + 1  # a text of the same sign


def test_token_files_of_an_empty_table(spark, tmp_path):
    files = wavelet.write_tokens(spark.createDataFrame([], SCHEMA), queries.BYTE_VOCABULARY, str(tmp_path))
    assert files.collect() == [] and wavelet.read_documents(files).collect() == []


def test_token_file_query(spark):
    tok, start = library(), 0
    got = {r.doc_id: r for r in queries.op12_token_files(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# Merkle manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests, arity):
    """Root, and each leaf's siblings, level by level."""
    paths, owners, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        cuts = range(0, len(level), arity)
        for lo in cuts:
            for k in range(lo, min(lo + arity, len(level))):
                for i in owners[k]:
                    paths[i].append(("".join(level[lo:k]), "".join(level[k + 1 : lo + arity])))
        owners = [sum(owners[lo : lo + arity], []) for lo in cuts]
        level = [h(*level[lo : lo + arity]) for lo in cuts]
    return level[0], paths


def merkle_by_force(leaves, arity):
    """{(group, order, leaf): list of (subroot, root, path)}; leaves: (group, order, digest)."""
    groups = defaultdict(list)
    for g, k, d in leaves:
        groups[g].append((k is not None, k or 0, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    root, above = tree([done[g][0] for g in names], arity)
    out = []
    for g, up in zip(names, above, strict=True):
        for (there, k, d), path in zip(sorted(groups[g]), done[g][1], strict=True):
            out.append((k if there else None, d, done[g][0], root, [tuple(s) for s in path + up]))
    return out


@pytest.mark.parametrize("arity, height", [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_merkle_equals_force(spark, arity, height):
    rng = random.Random(arity * height)
    rows = [(rng.choice([None, "", "a", "b", "é", "=", "hot", "hot", "hot"]), rng.choice([None, *range(60)]), h(str(rng.randrange(90)))) for _ in range(260)]
    rows += [("alone", 1, h("x"))] + [("same", 4, h("y"))] * 37
    table = spark.createDataFrame([(*r, "path") for r in rows], "lang string, doc_id long, leaf string, root_ string").repartition(3)
    got = merkle.merkle(table.select("lang", "doc_id", "leaf"), "leaf", "lang", "doc_id", arity, height)
    have = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(merkle_by_force(rows, arity), key=str)
    ends = got.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), merkle.folded(F.lit(h("other")), F.col("path")).alias("bad"), "root")
    assert all(r.ok and r.bad != r.root for r in ends.collect())


@pytest.mark.parametrize("rows", [[], [("a", 1, "d0")], [(None, None, "d0"), (None, None, "d0")]])
def test_merkle_of_few_rows(spark, rows):
    got = merkle.merkle(spark.createDataFrame(rows, "lang string, doc_id long, leaf string"), "leaf", "lang", "doc_id").collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert (got[0].subroot, got[0].root, got[0].path) == ("d0", "d0", [])
    if len(rows) == 2:
        assert {r.root for r in got} == {h("d0", "d0")} and len({str(r.path) for r in got}) == 2


def test_merkle_query_equals_sql_and_force_on_odd_rows(spark, tmp_path):
    rows = [(i, t, [None, "", "a", "é"][i % 4], [None, "s"][i % 2], [None, 5][i % 3 > 0]) for i, t in enumerate(ODD_TEXTS * 3)] + [(None, "orphan", None, None, 1), (2, "x", "a", "s", 3), (2, "x", "a", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(queries.SQL_MERKLE).fetchall(), key=str)
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more: h(*map(say, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    want = merkle_by_force([(r[2], r[0], leaf(r, 0)) for r in rows], 2)
    told = sorted((d, x, s, t, h("".join(a + b for a, b in p))) for d, x, s, t, p in want if d is not None)
    assert sorted(r[:5] for r in got if r[0] is not None) == told
    bad = {leaf(r, 0) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert bad and {r[1] for r in got if not r[6]} == bad
