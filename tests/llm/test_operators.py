"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "beta,", "Gamma", "δέλτα", "naïve", "don't", "<|endoftext|>", "x" * 300, " y", "12", "…"]
    texts = [None, "", "   \n\t", "One two", "a\x0bb\x0cc", "same line here\nsame line here\n\nother", "A B C D E " * 30, "z" * 5000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [texts[-1]] * 3 + [texts[-1] + " tail"] + [" ".join(f"w{i}" for i in range(9000))]
    sources = [None, "a", "b", "c", ""]
    out = [(i, t, "en", sources[i % 5], None) for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, "an orphan text", None, "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_rule(spark, docs, rows):
    from skewline.llm.mixing import word_count

    got = docs.select(F.sum(word_count("text"))).first()[0]
    assert got == sum(len(WORD.findall(r[1] or "")) for r in rows)


def test_token_counts(docs, rows, empty):
    import tokenizers

    from skewline.llm.tokenization import token_counts, vocabulary_path

    library = tokenizers.Tokenizer.from_file(vocabulary_path(VOCABULARY))
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    clash = docs.withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(None).cast("string"))
    for batch, split in ((1 << 24, 1 << 16), (64, 16)):
        assert Counter(map(tuple, token_counts(clash, VOCABULARY, batch_bytes=batch, split_bytes=split).collect())) == want
    assert token_counts(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoder_is_the_library(name):
    import tokenizers
    import sentencepiece

    from skewline.llm.tokenization import encoder, vocabulary_path

    rng = random.Random(1)
    alphabet = "aAzZ09 !'\"<|>#éÉßÀÿŁłǅIİıſΣς́ \x1c\x85漢🙂\t\n½²ªº·×÷$€" + "".join(map(chr, range(0xC0, 0x250)))
    texts = ["".join(rng.choice(["<|endoftext|>", "'ll", "don't"]) if rng.random() < 0.1 else rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    path = vocabulary_path(name)
    if name.endswith(".model"):
        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ids, n = encoder(name).ids([t.encode() for t in texts])
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n)] == want
    assert encoder(name).lengths([t.encode() for t in texts]) == [len(w) for w in want]


def test_packing(docs, rows, empty):
    import tokenizers

    from skewline.llm.packing import pack, token_pieces
    from skewline.llm.tokenization import vocabulary_path

    library = tokenizers.Tokenizer.from_file(vocabulary_path(VOCABULARY))
    pieces = token_pieces(docs, VOCABULARY, capacity=64)
    by_row = {}
    for p in pieces.collect():
        by_row.setdefault((p["doc_id"], p["row_no"] - p["piece"]), []).append(p)
    whole = Counter((k[0], b"".join(x["ids"] for x in sorted(v, key=lambda x: x["piece"]))) for k, v in by_row.items())
    assert whole == Counter((r[0], b"".join(i.to_bytes(4, "little") for i in [*library.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)
    packed = pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), len(rows), capacity=64).toPandas()
    assert len(packed) == pieces.count() and packed.groupby("sequence_id")["length"].sum().max() <= 64
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert packed["sequence_id"].nunique() <= math.ceil(packed["length"].sum() / 64) * 1.1 + 1
    assert pack(token_pieces(empty, VOCABULARY), 0).count() == 0


def test_pieces_of_texts_that_span_encode_batches(spark):
    from skewline.llm.packing import token_pieces

    texts = ["", "one two " * 40, "x" * 300, None, "and " * 30, "last text of the batch " * 50]
    for some in (texts, texts[-1:]):
        frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
        pieces = lambda **sizes: sorted(map(tuple, token_pieces(frame, VOCABULARY, capacity=64, **sizes).collect()))  # noqa: B023, E731
        assert pieces(batch_bytes=64, split_bytes=16) == pieces()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    from skewline.llm.packing import vector_best_fit

    lengths = np.random.default_rng(0).integers(1, 100, 500)
    bins, offset = vector_best_fit(lengths, (100, 3, 6000.0 + 4000), (1.0, 0.5, 0.5), rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 10000
        assert sorted(offset[bins == b].tolist()) == np.concatenate([[0], np.cumsum(own[np.argsort(offset[bins == b])])[:-1]]).tolist()
    with pytest.raises(ValueError):
        vector_best_fit(np.array([5]), (4, 1, 100.0))


def reference_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(prints, radius=4):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if label[j] < label[i] and bin(prints[i] ^ prints[j]).count("1") <= radius:
                    label[i], changed = label[j], True
    return label


def test_simhash(docs, rows, empty):
    from skewline.llm.simhash import near_duplicates, one_of_each

    prints = [reference_fingerprint(r[1]) for r in rows]
    label = components_by_force(prints)
    least = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    want = Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label))
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    kept = one_of_each(docs.withColumn("_hash", F.lit(1))).collect()
    assert len(kept) == len(set(label)) and Counter(r["doc_id"] for r in kept) == Counter(least.values())
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_simhash_links_across_tiles_and_parts(spark):
    from skewline.llm import simhash

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            f = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << bit
            prints.add(f)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    table = spark.createDataFrame([(f,) for f in signed], "f long")
    label = components_by_force(prints)
    want = {frozenset(s for s, x in zip(signed, label) if x == c) for c in set(label)}
    for n, tile in ((len(prints), 8), (1 << 22, 1024), (1 << 30, 16)):  # other numbers of parts
        roots = dict(map(tuple, simhash.components(simhash.links(table, n, tile=tile)).collect()))
        got = {}
        for s in signed:
            got.setdefault(roots.get(s, s), set()).add(s)
        assert {frozenset(v) for v in got.values()} == want


def test_mixing(docs, rows, empty):
    from skewline.llm.mixing import mix, mixed_documents, taken

    mixed = mix(docs, shards=4, block_words=64).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    total, got, target = sum(sizes.values()), Counter(), {}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), 1.5 * total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            want.update(share)
            break
        for s in full:
            want[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        open_ -= full
    blocks = set()
    for r in mixed:
        n = sum(s["length"] for s in r["slices"])
        assert n <= 2 * r["size"]
        got[r["source"]] += n
        target[r["source"]] = r["target"]
        for s in r["slices"]:
            assert 0 <= s["start"] and s["start"] + s["length"] <= r["size"] and 0 <= s["shard"] < 4
            blocks.add((r["source"], s["block"], s["shard"]))
    assert len(mixed) == len(rows) and all(abs(got[s] - want[s]) <= 1 and abs(target[s] - want[s]) < 1e-6 for s in order)
    assert len({b[:2] for b in blocks}) == len(blocks)  # a block is in one shard
    shards = Counter(b[2] for b in blocks)
    assert max(shards.values()) - min(shards[s] for s in range(4)) <= 3
    assert sorted(map(str, taken(mix(docs)).collect())) == sorted(map(str, taken(mix(docs)).collect()))
    out = mixed_documents(docs).collect()
    words = Counter()
    for r in out:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(words[s] - want[s]) <= 3 for s in order)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_mixed_documents_are_the_dealt_slices(docs):
    from skewline.llm.mixing import mix, mixed_documents

    for part_words in (1 << 30, 500):
        got = [(r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in mixed_documents(docs, shards=4, block_words=64, part_words=part_words).collect()]
        blocks = {}
        for r in mix(docs, shards=4, block_words=64).collect():
            for s in r["slices"]:
                blocks.setdefault((s["shard"], s["order_key"], r["source"] is None, r["source"] or ""), []).append((r["doc_id"], r["source"], s["length"]))
        assert len({b[0] for b in blocks}) == 4 and len(got) == sum(map(len, blocks.values()))
        for b in sorted(blocks):  # by shard, and by order_key within it
            own, got = got[: len(blocks[b])], got[len(blocks[b]) :]
            assert Counter(own) == Counter(blocks[b])


def test_permuted_and_quotas_in_chunks(spark):
    from skewline.llm.mixing import permuted, shard_quotas

    for n in (1, 2, 3, 7, 1000):
        orders = [[r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key))).collect()] for key in (1, 2)]
        assert all(sorted(o) == list(range(n)) for o in orders) and (n < 1000 or orders[0] != orders[1] != list(range(n)))
    blocks = [40, 0, 3, 100, 7, 1, 9]
    table = spark.createDataFrame(list(enumerate(blocks)), "source_no long, n_blocks long")
    for chunk in (3, 1024):
        ends = {r["source_no"]: r["ends"] for r in shard_quotas(table, 8, chunk=chunk).collect()}
        assert [ends[i][-1] for i in range(7)] == blocks and all(e == sorted(e) and len(e) == 8 for e in ends.values())
        totals = [sum(e[j] - (e[j - 1] if j else 0) for e in ends.values()) for j in range(8)]
        assert max(totals) - min(totals) <= 3
        assert len({e[0] for e in ends.values()}) > 2


def test_words_taken_are_what_the_shards_draw(docs, monkeypatch):
    """Other quotas of the shards, as valid, take other words; each source's total stays."""
    from skewline.llm import mixing

    def run(shards=4, seed=mixing.SEED):
        mixed = mixing.mix(docs, shards=shards, block_words=64, seed=seed)
        rows = mixed.collect()
        words = lambda r: sum(x["length"] for x in r["slices"] or [])
        assert sorted(str((r["doc_id"], words(r))) for r in rows) == sorted(str((r["doc_id"], r["taken"])) for r in mixing.taken(mixed).collect())
        totals = Counter()
        for r in rows:
            totals[r["source"]] += words(r)
        return sorted(str((r["doc_id"], r["source"], words(r))) for r in rows), totals, {x["shard"] for r in rows for x in r["slices"] or []}

    tree = mixing.shard_quotas
    drawn, totals, used = run()
    assert run()[0] == drawn and used == {0, 1, 2, 3}

    def to_one(quotas, shards, seed, at=0):
        return quotas.select("source_no", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.when(j >= at, F.col("n_blocks")).otherwise(F.lit(0).cast("long"))).alias("ends"))

    firsts = set()
    for at in (0, 2):
        monkeypatch.setattr(mixing, "shard_quotas", lambda q, n, s, at=at: to_one(q, n, s, at))
        other, same, used = run()
        assert other != drawn and same == totals and used == {at}
        firsts.add(str(other))
    assert len(firsts) == 2  # the same blocks in the same order, and yet others are drawn
    # Another seed for the tree alone.
    monkeypatch.setattr(mixing, "shard_quotas", lambda q, n, s: tree(q, n, s + 1))
    other, same, _ = run()
    assert other != drawn and same == totals


def test_hypergeometric_draws(spark):
    from skewline.llm.mixing import hypergeometric, uniform

    long = lambda n: F.lit(n).cast("long")
    rows = spark.range(8000).select(hypergeometric(long(50), long(20), long(15), uniform(F.lit(1), F.col("id"))).alias("k")).collect()
    count = Counter(r["k"] for r in rows)
    for k in range(16):
        p = math.comb(20, k) * math.comb(30, 15 - k) / math.comb(50, 15)
        assert abs(count[k] / 8000 - p) < 5 * math.sqrt(p / 8000) + 1e-3


def test_chat(spark):
    from skewline.llm.chat import digests, prefix_targets

    turns = [(1, 0, "system", "be <s>kind"), (1, 1, "user", None), (1, 2, "assistant", "</s><\\/s>[INST]"), (1, 3, "user", "x\n"), (1, 4, "assistant", ""), (1, 5, "user", "[\\\\/INST] ü🙂")]
    turns += [(2, 0, "user", "only"), (3, None, "a\\n\nb\\", "</s>"), (3, None, "assistant", "t"), (3, None, "assistant", "t"), (None, 1, None, "orphan"), (4, 7, "assistant", "\\")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in digests(prefix_targets(frame)).collect()}
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append(t)
    for conv, own in by.items():
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in own))
        replies = "".join(t[3] for t in own if t[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(replies)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest()
    examples = prefix_targets(frame).filter("conv_id = 1").orderBy("target").collect()
    assert [e["target"] for e in examples] == [2, 4, 6] and examples[2]["loss_chars"] == 0
    assert prefix_targets(frame.limit(0)).count() == 0


def statistics_by_force(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_quality_rules(spark, docs, rows, empty):
    from skewline.llm import quality_rules as q

    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = q.quality_rules(docs, q.fit(docs, labels)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", *q.BASE)) for r in got) == Counter((r[0], *statistics_by_force(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert q.quality_rules(empty, q.fit(empty, labels)).count() == 0


def test_repeat_words_long_and_short_ways_agree(monkeypatch):
    from skewline.llm import quality_rules as q

    rng = random.Random(2)
    for _ in range(60):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        short = q.repeat_words(words)
        monkeypatch.setattr(q, "LONG", 0)
        assert q.repeat_words(words) == short == statistics_by_force(" ".join(w.decode() for w in words))[4]
        monkeypatch.setattr(q, "LONG", 4096)


def test_trees_are_accurate_monotonic_and_flat():
    from skewline.llm.quality_rules import fit_trees

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - x[:, 1] ** 2 + 0.1 * rng.normal(size=3000) > -0.5).astype(float)
    trees = fit_trees(x[:2000], y[:2000], (1, 0, -1))
    assert ((trees.score(x[2000:]) >= 0) == y[2000:]).mean() > 0.93

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose([walk(r) for r in x[:50]], trees.score(x[:50]))
    grid = np.linspace(-3, 3, 50)
    for row in x[:20]:
        line = np.repeat(row[None], 50, 0)
        for j, sign in ((0, 1), (2, -1)):
            moved = line.copy()
            moved[:, j] = grid
            assert (sign * np.diff(trees.score(moved)) >= -1e-12).all()


def test_classifier(spark, empty):
    from skewline.llm import quality_classifier as q

    rng = random.Random(4)
    clean = [f"w{i}" for i in range(200)]
    out, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        kind = i % 5
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[rng.randrange(len(words))] = "grobian"
        out.append((i, " ".join(words), None, None, None))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame(out + [(1000, None, None, None, None), (None, "w1 w2", None, None, None)], SCHEMA)
    table = spark.createDataFrame(labels[:400] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, table)
    assert model.cuts[0] < model.cuts[1]
    got = {r["doc_id"]: r for r in q.graded(docs, model).collect()}
    held = [(got[i]["kept"], q_, t) for i, q_, t in labels[400:]]
    assert np.mean([k == (q_ == 1 and t == 0) for k, q_, t in held]) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got.values()) and got[1000]["score"] == 0.0
    assert q.graded(empty, q.fit(empty, table)).count() == 0


def test_classifier_finds_held_out_toxic_documents(spark):
    """Fitted on four fifths of the labels of sf0.1, it keeps clean documents of the last fifth and drops toxic and bad ones."""
    from skewline.llm import quality_classifier as q

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 2
    model = q.fit(docs, labels.filter(~hidden))
    got = q.graded(docs.join(labels.filter(hidden), "doc_id"), model).join(labels, "doc_id").toPandas()
    clean, toxic, bad = got[(got.quality == 1) & (got.toxic == 0)], got[(got.quality == 1) & (got.toxic == 1)], got[got.quality == 0]
    assert len(toxic) > 50 and (~toxic.kept).mean() >= 0.9 and (~bad.kept).mean() >= 0.95 and clean.kept.mean() >= 0.97


def test_top_k(spark):
    from skewline.llm.topk import top_k, whole_numbers

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 6)).round(2)
    vectors[::7] = vectors[0]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, [1.0, 2.0]), (50, [float(x) for x in vectors[50]])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(5)
    rows = whole_numbers(frame)
    for block in (8192, 7):
        got = {}
        for r in top_k(rows, rows.filter("vec_id % 50 = 0"), query_block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
        for q, v in {i: v for i, v in whole if i % 50 == 0}.items():
            want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    from skewline.llm.topk import top_k, whole_numbers

    data = [(0, [1e300, 1.0]), (1, [1.0, 1.0]), (2, [-1e300, 5.0]), (3, [3e15, 0.0]), (50, [-(2.0**54), 0.5])]
    rows = whole_numbers(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    whole = {r["vec_id"]: r["v"] for r in rows.collect()}
    assert whole == {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v] for i, v in data}
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in top_k(rows, rows.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    clip = lambda n: max(-(2**63 - 2), min(2**63 - 2, n))
    want = []
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)
        want += [(q, i, -s) for s, i in best[:5]]
    assert got == want


def test_top_k_of_a_repeated_query_row(spark):
    from skewline.llm.topk import top_k, whole_numbers

    data = [(0, [1.0, 2.0])] * 8 + [(i, [1.0, 2.0]) for i in (3, 3, 4, 6, 7, 8)] + [(i, [0.5, 0.25 * i]) for i in (1, 2)]
    rows = whole_numbers(spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1))
    got = top_k(rows, rows.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 5 * 256 * 256) for i in (3, 3, 4, 6, 7)]


def test_ball_tree_skips_leaves():
    from skewline.llm.topk import NONE, BallTree, Best, search

    rng = np.random.default_rng(0)
    points = (rng.normal(size=(4000, 2)) * 100).astype(np.int64)
    queries = (rng.normal(size=(1, 2)) * 100).astype(np.int64)
    best = Best(1, 5)
    tree = BallTree(points.astype(float))
    looked = search(tree, points, np.arange(4000), np.array([-1]), queries, np.array([NONE]), best)
    score = (points @ queries[0]).tolist()
    assert best.score[0].tolist() == sorted(score, reverse=True)[:5] and looked < 4000 / 64 / 4


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="sidebar"><p>Side</p></div><div id=cookie-notice>We use</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Five &lt;six&gt; &#233;</p><form><input>send</form><aside>aside</aside><ul><li>item a<li>item b</ul>
<div class="comments"><p>First!</p></div><table><tr><td>c1<td>c2</table>loose</article><div class=ad>buy</div><footer>(c)</footer>"""


def test_html(spark):
    from skewline.llm.site_tree import extract

    want = "Head & line\nOne two three four\nFive <six> é\nitem a\nitem b\nc1\nc2\nloose"
    rows = [(1, "http://h.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://h.example/2", "plain text"), (1, "http://h.example/1", PAGE), (None, "http://h.example/3", "<p>a<!-- x --><p>b < c &amp;amp; d")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in extract(frame).collect())
    assert got == Counter([(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain text", 10), (1, want, len(want)), (None, "a\nb < c &amp; d", 15)])
    assert extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_site_tree_removes_what_all_pages_repeat(spark, most):
    from skewline.llm.site_tree import extract

    page = lambda i: f"<body><div class=x1><p>The same line on all pages</div><div class=x2><p>Own text number {i} of this page<p>and more {i * 7}</div></body>"
    frame = spark.createDataFrame([(i, f"https://one.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    for r in extract(frame, most).collect():
        assert r["text"] == f"Own text number {r['page_id']} of this page\nand more {r['page_id'] * 7}"


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("copies", [7, 8, 40])
def test_site_tree_counts_distinct_pages(spark, copies, most):
    from skewline.llm.site_tree import extract

    article = lambda own, n: f"<nav>seen {n}</nav><article><h1>Head of {own}</h1><p>First paragraph of {own}<p>Second one{{}}</article>"
    plain = "<body><div class=x><p>A page without an article<p>has its text</div>"
    rows = [(i, "https://one.example/a", article("a mirror", i).format("")) for i in range(copies)]
    rows += [(100 + i, "https://two.example/b", plain) for i in range(copies)]
    rows += [(200 + i, "https://near.example/c", article("near copies", 0).format(f"<p>Read {i} times")) for i in range(copies)]
    rows += [(300 + i, f"https://many.example/{i % 20}", article(f"page {i % 20}, with words of its own", i).format("<p>Tell us")) for i in range(20 * copies // 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for r in extract(frame, most).collect():
        i = r["page_id"]
        if i < 100:
            want = "Head of a mirror\nFirst paragraph of a mirror\nSecond one"
        elif i < 200:
            want = "A page without an article\nhas its text"
        elif i < 300:
            want = f"Head of near copies\nFirst paragraph of near copies\nSecond one\nRead {i - 200} times"
        else:
            own = f"page {(i - 300) % 20}, with words of its own"
            want = f"Head of {own}\nFirst paragraph of {own}"
        assert r["text"] == want


def test_lm_scores(docs, rows, empty):
    from skewline.llm.context_mixing import lm_scores

    tokens = [[*(r[1] or "").encode().lower().split(), b"\n"] for r in rows]
    out = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    count = Counter(w for t, h in zip(tokens, out) if not h for w in t)
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    want = sorted((str(r[0]), h, len(t), sum(count[w] > 0 for w in t), n, round(base(t), 6)) for r, t, h in zip(rows, tokens, out))
    for top in (50_000, 3):
        got = lm_scores(docs.withColumn("word", F.lit(1)).withColumn("block", F.lit("x")), top_words=top).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scores(empty).count() == 0


def lm_parts(texts, held, top):
    """The dictionary and a block of texts, as the operator makes them."""
    from skewline.llm import context_mixing as c

    split = [[*lower(t).encode().split(), c.END] for t in texts]
    count = Counter(w for t, h in zip(split, held) if not h for w in t)
    words = [c.END, *sorted((w for w in count if w != c.END), key=lambda w: (-count[w], w))[:top]]
    book = c.dictionary_of(words, [count[w] for w in words], sum(count.values()) - sum(count[w] for w in words))
    rare, symbols = {}, []
    for t in split:
        symbols += [book.number[w] if w in book.number else -1 - rare.setdefault(w, len(rare)) for w in t]
    return split, book, c.Block.of(np.array([len(t) for t in split]), np.array(held), np.array(symbols, np.int32), list(rare), book)


def test_lm_code_is_complete():
    from skewline.llm.context_mixing import huffman

    for counts in ([5], [1, 1], [1, 2, 3, 4, 100], list(range(1, 300))):
        starts, depth, nodes, bits, n, ones = huffman(np.array(counts))
        paths = [tuple(zip(nodes[s : s + d].tolist(), bits[s : s + d].tolist())) for s, d in zip(starts, depth)]
        assert len(set(paths)) == len(counts) and (len(counts) == 1 or sum(2.0**-d for d in depth) == 1)
        for node in range(len(counts) - 1):
            under = [(c, dict(p)[node]) for c, p in zip(counts, paths) if node in dict(p)]
            assert n[node] == sum(c for c, _ in under) and ones[node] == sum(c for c, b in under if b)


def test_lm_mixture_is_proper():
    """Over all words that may come next, and the escape, the mixed probabilities add up to one, whatever the weights."""
    from skewline.llm import context_mixing as c

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    training = [" ".join(rng.choice(words, 30)) for _ in range(5)]
    table = c.Slots(rng.integers(-40, 40, 1 << c.AFTER_BITS).astype(np.int8), rng.integers(0, 60, 1 << c.AFTER_BITS).astype(np.uint8))
    mixer = c.Mixer(rng.normal(size=c.STATES * c.INPUTS * c.LEVELS).astype(np.float32), rng.random(c.STATES * c.BUCKETS) * 3, 3 + rng.random(c.STATES * c.BUCKETS))
    for guess, state in ((-1, 0), (3, 5), (c.RARE_CODE + 9, 9)):
        total = 0.0
        for last in [*words, "unheard"]:
            _, book, block = lm_parts([*training, f"w1 w2 w1 w2 w1 {last}"], [False] * 5 + [True], 10)
            at = len(block.symbols) - 2
            expect, states = np.full(at + 2, -1, np.int32), np.zeros(at + 2, np.uint8)
            expect[at], states[at] = guess, state
            if block.symbols[at] < 0 and last != "unheard":
                continue
            x, where, gate, bits, owner = c.token_bits(book, table, block, expect, states, slice(0, at + 2))
            p, bucket = mixer.probability(x, where, gate)
            p = mixer.corrected(p, bucket)
            total += np.prod(np.where(bits, p, 1 - p)[owner == at].astype(float))
        end = lm_parts([*training, "w1 w2 w1 w2 w1"], [False] * 5 + [True], 10)[2]
        at = len(end.symbols) - 1
        expect, states = np.full(at + 1, -1, np.int32), np.zeros(at + 1, np.uint8)
        expect[at], states[at] = guess, state
        x, where, gate, bits, owner = c.token_bits(book, table, end, expect, states, slice(0, at + 1))
        p, bucket = mixer.probability(x, where, gate)
        p = mixer.corrected(p, bucket)
        total += np.prod(np.where(bits, p, 1 - p)[owner == at].astype(float))
        assert abs(total - 1) < 1e-4


def test_lm_inputs_by_force(monkeypatch):
    """Every input, weight and gate of a small block, and the online mixer, token by token and bit by bit, without vectors."""
    from skewline.llm import context_mixing as c

    monkeypatch.setattr(c, "STEP", 128)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "eel", "f.", "G", "new" + str(rng.randrange(9))]) for _ in range(rng.randint(0, 40))) for _ in range(8)]
    held = [i % 3 == 0 for i in range(8)]
    split, book, block = lm_parts(texts, held, 5)
    n = np.random.default_rng(1)
    table = c.Slots(n.integers(-99, 99, 1 << c.AFTER_BITS).astype(np.int8), n.integers(0, 90, 1 << c.AFTER_BITS).astype(np.uint8))
    expect = n.integers(-1, 6, len(block.symbols)).astype(np.int32)
    state = np.where(expect >= 0, n.integers(1, c.STATES, len(expect)), 0).astype(np.uint8)
    x, at, gate, bits, owner = c.token_bits(book, table, block, expect, state, slice(0, len(block.symbols)))
    mixer, check, squares = c.Mixer.blank(c.STATES, c.INPUTS), c.Mixer.blank(c.STATES, c.INPUTS), np.full(c.STATES * c.INPUTS * c.LEVELS, 1e-6)
    got = mixer.learn(x, at, gate, bits, squares, ~block.held[owner])
    weights, ones, total, steps = check.weights.astype(float), Counter(), Counter(), np.full(len(check.weights), 1e-6)
    hi = 0
    while hi < len(bits):
        lo, hi = hi, min(hi + c.step_size(hi), len(bits))
        slope, seen = np.zeros(len(weights)), []
        for i in range(lo, hi):
            dot = min(11.9, max(-11.9, sum(weights[at[j, i]] * x[j, i] for j in range(c.INPUTS))))
            p, bucket = 1 / (1 + math.exp(-dot)), gate[i] * c.BUCKETS + int((dot + 12) * (c.BUCKETS - 1) / 24 + 0.5)
            told = (p + (ones[bucket] + p) / (total[bucket] + 1)) / 2
            assert abs(got[i] - math.log2(told if bits[i] else 1 - told)) < 2e-3
            if not block.held[owner[i]]:
                seen.append((bucket, int(bits[i])))
                for j in range(c.INPUTS):
                    slope[at[j, i]] += (p - bits[i]) * x[j, i]
        for bucket, b in seen:
            ones[bucket] += b
            total[bucket] += 1
        slope /= max(1, len(seen))
        steps += slope**2
        weights -= c.RATE * slope / np.sqrt(steps)
    path = lambda w: [(int(book.nodes[i]), int(book.bits[i])) for i in range(book.starts[w], book.starts[w] + book.depth[w])]
    leaf = lambda w: book.number.get(w, len(book.number))
    logit = lambda n, ones: math.log((ones + c.PRIOR) / (n - ones + c.PRIOR))
    level = lambda n: 0 if n < 1 else min(c.LEVELS - 1, 1 + int(math.log2(n)))
    bit = token = 0
    for words, out in zip(split, held):
        own = Counter(step for w in words for step in path(leaf(w)))
        said, followers = Counter(), {}
        for i, w in enumerate(words):
            last = followers.get(words[i - 1], []) if i else []
            guess = [(last[-1], 1 + (len(last) > 1) + (len(last) > 1 and last[-1] == last[-2]))] if last else []
            steps = path(leaf(w))
            for k, (node, b) in enumerate(steps):
                assert owner[bit] == token and bits[bit] == b
                total, ones = book.node_n[node], book.node_ones[node]
                if not out and level(total) < c.LEVELS - 1:
                    total, ones = max(0, total - own[node, 0] - own[node, 1]), max(0, ones - own[node, 1])
                assert abs(x[0, bit] - logit(total, min(ones, total))) < 1e-4
                before = said[node, 0] + said[node, 1]
                assert abs(x[2, bit] - logit(before, said[node, 1])) < 1e-4
                agrees = lambda p: k < len(p) and p[: k + 1][:-1] == steps[:k] and p[k][0] == node  # noqa: B023, E731
                want, trust = 0.0, 0
                if guess and agrees(path(leaf(guess[0][0]))):
                    want, trust = (1.5 if path(leaf(guess[0][0]))[k][1] else -1.5), guess[0][1]
                assert x[3, bit] == want
                in_state = 0
                if expect[token] >= 0 and agrees(path(int(expect[token]))):
                    in_state = int(state[token])
                    assert x[4, bit] == (1.5 if path(int(expect[token]))[k][1] else -1.5)
                else:
                    assert x[4, bit] == 0
                assert gate[bit] == in_state
                base = in_state * c.INPUTS * c.LEVELS
                assert [int(at[j, bit]) - base - j * c.LEVELS for j in (0, 2, 3, 4)] == [level(total), level(before), trust, 0]
                bit += 1
            for step in steps:
                said[step] += 1
            if i:
                followers.setdefault(words[i - 1], []).append(w)
            token += 1
    assert bit == len(bits)


def test_lm_memory_by_force(spark, monkeypatch):
    """What the shards answer to blocks, against counts of all followers; own text left out, blocks and shards of any number."""
    from skewline.llm import context_mixing as c

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) + (f" rare{rng.randrange(4)} a b" if rng.random() < 0.4 else "") for _ in range(60)]
    held = [rng.random() < 0.2 for _ in texts]
    split, book, _ = lm_parts(texts, held, 4)
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean").repartition(3).cache()
    sent = spark.sparkContext.broadcast(book)
    monkeypatch.setattr(c, "BLOCK_BYTES", 200)
    blocks = c.blocks_of(rows, sent)
    after, askers = {}, {}
    pad = lambda words: [None, None, *words]
    for i, words in enumerate(split):
        w = pad(words)
        for a, b, x in zip(w, w[1:], w[2:]):
            askers.setdefault((a, b), set()).add(i)
            if not held[i]:
                after.setdefault((a, b), Counter())[x, i] += 1
    for bits in (0, 5):
        hits = 0
        for row in c.with_memory(blocks, bits, sent).collect():
            expect, state = c.expanded(row["expect"], "<i4"), c.expanded(row["state"], "u1")
            at = 0
            for i in row["ids"]:
                w = pad(split[i])
                for a, b, x in zip(w, w[1:], w[2:]):
                    others = Counter()
                    for (y, j), n in after.get((a, b), {}).items():
                        others[y] += n * (j != i)
                    most = max(others.values(), default=0)
                    if len(askers[a, b]) < 2 or not most:
                        assert expect[at] == -1 and state[at] == 0
                    elif expect[at] >= 0:
                        said = {y for y in others if book.number.get(y, c.RARE_CODE + xxhash.xxh64_intdigest(y) % ((1 << 24) - c.RARE_CODE)) == expect[at]}
                        assert len(said) == 1 and state[at] > 0
                        hits += others[said.pop()] == most
                    at += 1
            assert at == len(expect)
        assert hits > 200


def test_lm_scores_hang_on_no_partitions(spark):
    from skewline.llm.context_mixing import lm_scores

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in (5, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(lm_scores(docs).toPandas().sort_values("doc_id").reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got[0]["doc_id"] == got[1]["doc_id"]).all() and np.allclose(got[0]["score"], got[1]["score"], rtol=1e-12, atol=1e-9)
    assert (got[0]["score"] < 0).all()


def test_lm_copies_and_held_out_text(spark):
    """A model of the corpus: a text that occurs twice is told from one that doesn't, also if one of the two was never learned."""
    from skewline.llm.context_mixing import lm_scores

    rng = random.Random(12)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{i}" for i in range(4000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(120))
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(400)]
    twice, learned, rows = text(), next(i for i in range(300, 400) if not out[i]), []
    copies = {next(i for i in range(300) if out[i]), next(i for i in range(300) if not out[i]), learned}
    rows = [(i, twice if i in copies else text()) for i in range(400)] + [(1000, "z" * 70_000 + " " + "\u00e9" * 40_000)]
    got = {r["doc_id"]: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    per_token = {i: r["score"] / r["n_tokens"] for i, r in got.items()}
    others = [v for i, v in per_token.items() if i not in copies and i != 1000]
    assert all(per_token[i] > 0.75 * max(others) for i in copies), (sorted(others)[-3:], [per_token[i] for i in copies])
    assert math.isfinite(got[1000]["score"])


def test_lm_spelling_is_proper_and_learned(spark):
    from skewline.llm import context_mixing as c

    code = c.byte_code([b"then", b"this", b"or"])
    blank = c.Speller(code, c.Slots(np.zeros(c.SLOTS, np.int8), np.zeros(c.SLOTS, np.uint8)), c.Mixer.blank(c.GATES, len(c.TABLE_BITS)))
    depth = code[1]
    assert np.allclose(blank.log2_words([b"ab", b"c"], False), [-depth[[97, 98, 32]].sum(), -depth[[99, 32]].sum()])
    rng = random.Random(1)
    words = sorted({"".join(rng.choice(["th", "en", "or", "is"]) for _ in range(rng.randint(2, 6))) for _ in range(500)})
    table = spark.createDataFrame([(w.encode(), 1) for w in words[::2]], "word binary, n long")
    speller = c.learn_spelling(table, len(words[::2]), code)
    held = speller.log2_words([w.encode() for w in words[1::2]], False)
    assert held.sum() / sum(map(len, words[1::2])) > -2.5
    own = speller.log2_words([w.encode() for w in words[::2]], True)
    assert abs(own.sum() / sum(map(len, words[::2])) - held.sum() / sum(map(len, words[1::2]))) < 0.7
    first = speller.log2_words([bytes([b]) for b in range(256)], False)
    assert (2.0**first).sum() <= 1


def test_lm_rare_words_travel_packed(spark, monkeypatch):
    """Rare words go to shards and back a block at a time, not a row for each text and word; what comes back, by force."""
    from skewline.llm import context_mixing as c

    rng = random.Random(3)
    texts = [" ".join(["a", "b", *(f"{rng.choice('xyz')}{rng.randrange(40)}" for _ in range(rng.randint(0, 12)))]) for _ in range(60)]
    held = [rng.random() < 0.3 for _ in texts]
    split, book, _ = lm_parts(texts, held, 2)
    sent = spark.sparkContext.broadcast(book)
    code = c.byte_code([b"x1", b"y2"])
    blank = c.Speller(code, c.Slots(np.zeros(c.SLOTS, np.int8), np.zeros(c.SLOTS, np.uint8)), c.Mixer.blank(c.GATES, len(c.TABLE_BITS)))
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean").repartition(3).cache()
    monkeypatch.setattr(c, "BLOCK_BYTES", 300)

    def made(left, row, block, told):
        n = len(row["rare"])
        return pa.table({"word": pa.array(row["rare"], pa.binary()), "times": pa.array(told.times, pa.int64()), "own": pa.array(told.spelled[1][:n]), "other": pa.array(told.spelled[0][:n]), "ids": pa.array([left.column("ids").to_pylist()[0]] * n, pa.list_(pa.int64()))})

    want = Counter(w for t, h in zip(split, held) if not h for w in t)
    for bits in (0, 3):
        got = c.told_blocks(c.blocks_of(rows, sent), bits, sent, spark.sparkContext.broadcast(blank), made, "word binary, times long, own double, other double, ids array<long>").collect()
        assert len({tuple(r["ids"]) for r in got}) > 3
        for r in got:
            word = bytes(r["word"])
            spelled = blank.log2_words([word], False)[0]
            assert r["times"] == want[word]
            assert abs(r["own"] - spelled * any(word in split[i] and not held[i] for i in r["ids"])) < 1e-5
            assert abs(r["other"] - spelled * any(word in split[i] and held[i] for i in r["ids"])) < 1e-5
    plan = c.lm_scores(rows.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3


def test_lm_work_is_done_once(monkeypatch):
    """A word after a word is looked up once for all blocks of a task, a beginning that words share is spelled once, and a bit's counts
    in its passage come from one count a bit."""
    from skewline.llm import context_mixing as c

    texts = ["a b a c", "a b b", "c a b a c"]
    split, book, block = lm_parts(texts, [False] * 3, 5)
    row = {"sizes": [len(t) for t in split], "held": [False] * 3, "symbols": c.squeezed(block.symbols), "rare": b""}
    looked, whole, spelled, path = [], c.bit_slots, [], c.paths
    monkeypatch.setattr(c, "paths", lambda book, symbols: looked.append(len(symbols)) or path(book, symbols))
    monkeypatch.setattr(c, "quantized_table", lambda parts, *_: parts)

    class Blocks:
        def mapInArrow(self, work, _):
            return list(work(iter([pa.RecordBatch.from_pylist([row]), pa.RecordBatch.from_pylist([row])])))

    class Sent:
        value = book

    parts = c.after_table(Blocks(), 1, Sent)
    assert sum(looked) == len({pair for t in split for pair in zip([None, *t], t)})
    total = sum(int(c.expanded(raw[1:], f"<i{raw[0]}").sum()) for part in parts for raw in part.column("raw").to_pylist())
    assert total == 2 * sum(int(book.depth[book.number[w]]) for t in split for w in t)
    words = [b"ab", b"abc", b"abcd" * 9000, b"abcd" * 9000 + b"e", b"b", b"ab\0", b"x" * 30, b"x" * 29 + b"y"]
    code = c.byte_code([b"abcd", b"xy"])
    rng = np.random.default_rng(4)
    speller = c.Speller(code, c.Slots(rng.integers(-50, 50, c.SLOTS).astype(np.int8), rng.integers(0, 60, c.SLOTS).astype(np.uint8)), c.Mixer.blank(c.GATES, len(c.TABLE_BITS)))
    alone = [[speller.log2_words([w], own)[0] for w in words] for own in (False, True)]
    monkeypatch.setattr(c, "bit_slots", lambda code, hashes, data: spelled.append(len(data)) or whole(code, hashes, data))
    assert np.allclose([speller.log2_words(words[::-1], own)[::-1] for own in (False, True)], alone, rtol=1e-9)
    spelled.clear()
    speller.log2_words([b"begin", b"beginner", b"begun"], False)
    assert sum(spelled) == len("begin ") + len("ner ") + len("un ")
    keys = rng.integers(0, 30, 500)
    assert c.earlier(keys).tolist() == [int((keys[:i] == k).sum()) for i, k in enumerate(keys)]


def test_lm_word_counts_by_force(spark, monkeypatch):
    """Words counted in Arrow, folded and let go now and then, against a plain count; nulls, blanks of all kinds and repeats."""
    from skewline.llm import context_mixing as c

    rng = random.Random(8)
    texts = [None, "", " \t ", "\u00a0 A a\x0bb", *(" ".join(f"W{rng.randrange(300)}" for _ in range(rng.randint(0, 50))) for _ in range(400))]
    want = Counter(w for t in texts for w in [*lower(t or "").encode().split(), c.END])
    assert c.listed(pa.array([b"a", b"\xc2\xa0", b"bc"])) == [b"a", b"\xc2\xa0", b"bc"] and c.listed(pa.array([], pa.binary())) == []
    for most in (20, 250_000):
        monkeypatch.setattr(c, "FLUSH_WORDS", most)
        got = c.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()
        assert len(got) == len(want) and {bytes(r["word"]): r["n"] for r in got} == want


def test_classifier_learns_in_a_task(spark, monkeypatch):
    """The sample's features, some 12 KB a document, don't pass through the driver; the model is that of a fit over all features."""
    from skewline.llm import quality_classifier

    docs = [(i, f"fair words number {i}" if i % 2 else f"bad stuff bad {i} stuff!") for i in range(200)]
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    found = [quality_classifier.features(t.encode()) for _, t in docs]
    grades, sizes = np.array([2 * (i % 2) for i, _ in docs]), np.array([len(s) for s, _ in found])
    want = quality_classifier.fit_ordinal(np.concatenate([s for s, _ in found]).astype(np.int32), np.concatenate([v for _, v in found]).astype(np.float32), sizes, grades, np.arange(len(docs)))
    monkeypatch.setattr(quality_classifier, "fit_ordinal", None)
    got = quality_classifier.fit(frame, labels)
    assert want.weights.any() and np.array_equal(got.weights, want.weights) and np.array_equal(got.cuts, want.cuts)


def test_stages_and_queries(spark, tmp_path):
    import corpus_pipeline
    from skewline.llm.queries import oracle_sql, queries

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    assert set(oracle_sql()) <= set(queries()) and sorted(int(q[2:].split("_")[0]) for q in queries() if q.startswith("op")) == list(range(1, 11))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    before = docs.toPandas().set_index("doc_id")
    frame, sf = docs, "/root/testdata/sf0.001"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, frame, sf).write.parquet(path)
        frame = spark.read.parquet(path)
        if k < 4:
            assert frame.columns == docs.columns
            now = frame.toPandas()
            if k < 3:
                assert now["doc_id"].is_unique and set(now["doc_id"]) <= set(before.index)
                good = set(labels.doc_id[(labels.quality == 1) & (labels.toxic == 0)])
                assert k > 1 or len(good & set(now["doc_id"])) >= 0.9 * len(good)
    assert frame.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><p>{}</div>',
        '<main class="layout-with-nav"><p>{}</main>',
        '<div class="story share-enabled"><p>{}</div>',
        '<body class="menu-open"><div class="sidebar-open"><p>{}</div><div class="menu"><p>Home</div>',
        '<div class="x"><p>{}</div><article class="related"><h2>Teaser</h2></article>',
    ],
)
def test_page_is_not_lost_to_a_name_or_a_teaser(page):
    from skewline.llm.site_tree import main_text

    text = "The main text of the page, which is longer than all the rest of it."
    assert main_text(page.format(text), {}) == text


def test_site_tree_decides(spark):
    """Without telling names, the tree alone finds what the pages of a host share; hosts of one page are judged by the others."""
    from skewline.llm.site_tree import extract, main_text

    page = lambda h, i: f"<div class=k1><p>Welcome to host {h}<p>All rights kept</div><div class=k2><p>Text {i} of {h} says this<p>and that {i * 7 + h}</div><div class=k3><p>Write to {h}</div>"
    rows = [(100 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h, n in enumerate((30, 12, 5, 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for most, host_pages in ((100_000, 20_000), (0, 20_000), (0, 7)):
        got = {r["page_id"]: r["text"] for r in extract(frame, most, host_pages).collect()}
        for i, _, html in rows:
            h, n = divmod(i, 100)
            assert got[i] == f"Text {n} of {h} says this\nand that {n * 7 + h}" != main_text(html, {})


def importance_by_force(pages):
    """{(host, element, shows): importance} of all branches and repeated blocks, from lists of pages' (path, children) and (path, text)."""
    from skewline.llm import site_tree as s

    shows, own = {}, {}
    for host, html in pages:
        _, nodes = s.page_nodes(html)
        for element, what, is_block, name in nodes:
            shows.setdefault((host, element, is_block), Counter())[what] += 1
            own[element] = name
    most = {h: max(sum(c.values()) and max(c.values()) for (x, _, b), c in shows.items() if x == h and not b) for h, _ in pages}
    parts, blocks = {}, {}
    for host, element in {k[:2] for k in shows}:
        style, text = shows.get((host, element, False), Counter()), shows.get((host, element, True), Counter())
        m = sum(style.values())
        presentation = 1 - sum(n * math.log(n) for n in style.values()) / (m * math.log(m)) if m > 1 else 1.0
        all_blocks = sum(text.values())
        pages_ = min(max(most[host], max(text.values(), default=0)), all_blocks)
        one = lambda n: 1 - math.log(n) / math.log(pages_) if pages_ > 1 else 1.0  # noqa: B023, E731
        content = 1 - sum(n * (1 - one(n)) for n in text.values() if n > 1) / all_blocks if all_blocks else 1.0
        parts[host, element] = (s.DECAY ** len(style), presentation, content, max(m, pages_) - 1)
        blocks.update({(host, element, w): (one(n), pages_ - 1) for w, n in text.items() if n > 1})
    whole = {k: (1 - d) * p + d * c for k, (d, p, c, _) in parts.items()}
    weight = {k: x[3] for k, x in parts.items()}
    vote = {k: w / (w + s.BACKING) for k, w in weight.items()}
    usual = lambda e, value: (sum(vote[k] * value(k) for k in parts if own[k[1]] == own[e]) + 1) / (sum(vote[k] for k in parts if own[k[1]] == own[e]) + 1)
    out = {(*k, 0): (weight[k] * whole[k] + s.BACKING * usual(k[1], whole.get)) / (weight[k] + s.BACKING) for k in parts}
    out.update({k: (w * v + s.BACKING * usual(k[1], lambda x: parts[x][2])) / (w + s.BACKING) for k, (v, w) in blocks.items()})
    return out


def test_site_tree_by_force(spark):
    from skewline.llm import site_tree as s

    rng = random.Random(8)
    pages = []
    for h, n in enumerate((14, 6, 1)):
        for i in range(n):
            shared = "".join(f"<p>shared {h} {rng.randrange(3)}" for _ in range(rng.randint(0, 3)))
            pages.append((f"h{h}", f"<div class=a><div>{shared}</div></div><div class=b><h1>{i} {h}</h1>{'<p>own ' * rng.randint(1, 3)}{i}<ul><li>x<li>{rng.randrange(4)}</ul></div>"))
    frame = spark.createDataFrame([(f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "url string, html string").repartition(3)
    got = {(r["host"], r["element"], r["shows"]): r["importance"] for r in s.low_branches(s.tree_counts(frame)).collect()}
    distinct = {}
    for h, p in pages:
        says, nodes = s.page_nodes(p)
        if (h, says) not in distinct or nodes < distinct[h, says][0]:
            distinct[h, says] = (nodes, p)
    force = importance_by_force([(h, p) for (h, _), (_, p) in distinct.items()])
    want = {k: v for k, v in force.items() if v < (s.LISTED_BLOCK if k[2] else s.LISTED_BRANCH) - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 5


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_documents(spark, docs, rows, empty, stage):
    """Nulls in every column, empty and long texts, repeated rows, columns of clashing names, and an empty table."""
    import corpus_pipeline

    _, run = corpus_pipeline.STAGES[stage]
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA))
    for c in ("row", "kept", "score", "size", "slices", "f", "h", "part", "grade", "low", "bucket"):
        odd = odd.withColumn(c, F.lit("x"))
    got = run(spark, odd, "/root/testdata/sf0.001")
    if stage == 4:
        by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
        assert all(r["n"] == r["end"] <= 2048 for r in by) and got.filter("piece = 0").count() == len(rows) + 2
    else:
        assert got.columns == odd.columns
        had = Counter((r["doc_id"], r["text"]) for r in odd.collect())
        for r in got.collect():
            assert stage == 3 or had[r["doc_id"], r["text"]] > 0
            assert r["row"] == "x"
    assert run(spark, empty, "/root/testdata/sf0.001").count() == 0
