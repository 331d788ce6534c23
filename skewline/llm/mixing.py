"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source's documents are put in a random order fixed by a hash, and its words in that order are cut into blocks of
`block_words`. The mix takes all blocks as often as `target` holds the whole source, and some blocks of one more pass; how many is
the source's exact block quota. The quotas of all sources, those of whole passes and of the last one apart, are split among output
shards down a binary tree: at every node the blocks that go left are a multivariate hypergeometric draw from the node's quotas, so
every shard gets its exact number of blocks and every quota is dealt. Then shards draw: the blocks of the last pass, in a keyed
permutation, are cut into disjoint pools, one a shard, each of the shard's quota and an even part of the blocks that nobody takes,
and a shard takes its quota from its pool. So the tree's quotas decide which blocks, and with them which words, the mix takes; other
quotas take others. Of the last blocks drawn as many words are left out as are over the target, so it is met to the word. Blocks of
whole passes go to shards as disjoint ranges of their permutation. A shard is shuffled locally by `order_key`. All draws come from
hashes of `seed`, so reruns agree.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; they share `share` times all words; no target passes
`max_epochs` times its source's words, and the excess goes to the others by weight until none passes (water level).

Scale: texts are read once for their word counts; what is shuffled is a few numbers a document, except for
`mixed_documents`, which reads texts again and shuffles them to where the slices are dealt. The running word offset of
a document is found in two levels (buckets of about `BUCKET_DOCS` documents by hash, then within a bucket), so a hot source
is spread over as many tasks as it has buckets. Permutations are worked out row by row. The sources of
a node of the tree are drawn in chunks of `CHUNK`; the number of shards grows with the words. The table of sources is
broadcast only up to `MAX_BROADCAST` rows, that of the shards' draws only up to `MAX_DRAWS` draws.

Defined results: a null text has size 0, documents of size 0 are never taken; a null source is a source of its own; a null
id stays null; repeated rows are mixed one by one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, text_or_empty, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Shards at least, and words of a shard at most, about.
SHARDS = 16
SHARD_WORDS = 1 << 27
BLOCK_WORDS = 4096
BUCKET_DOCS = 256
#: Words of a partition of the mixed documents: some 8 MB of text.
PART_WORDS = 1_200_000
MAX_BROADCAST = 20_000
#: Draws (sources times shards) that are broadcast at most, 32 bytes each.
MAX_DRAWS = 500_000
#: Sources of a chunk; levels of the tree between two tables.
CHUNK = 1024
LEVELS = 1
#: Rounds of a keyed permutation, and how often it is walked on at most, to land in a range.
ROUNDS = 4
WALKS = 64


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = SEED, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, h), and with `whole` the row itself as `row`."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(text_column).alias("size"), *row)
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_no, n_docs, source_size, target double, take long, buckets long), one row a source."""
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("source_no", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * max_epochs).cast("double")
    level = ranked.withColumns({"weight": weight, "cap": cap}).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = one.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "all_size": F.sum("source_size").over(one), "all_weight": F.sum("weight").over(one), "place": F.row_number().over(one.orderBy("ratio", "source_no"))})
    level = level.withColumn("water", (F.col("all_size") * share - F.col("full")) / (F.col("all_weight") - F.col("gone")))
    level = level.withColumn("water", F.min_by(F.when(F.col("water") <= F.col("ratio"), F.col("water")), F.when(F.col("water") <= F.col("ratio"), F.col("place"))).over(one))
    target = F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    out = level.withColumn("target", target).withColumn("take", F.least((F.col("source_size") * max_epochs), F.floor(F.col("target") + 0.5)))
    return out.select("source", F.col("source_no").cast("long").alias("source_no"), "n_docs", "source_size", "target", "take", F.ceil(F.col("n_docs") / BUCKET_DOCS).alias("buckets"))


def _no_longs() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also inside a lambda function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among `draws` of `pop` without replacement, at the quantile u in [0, 1).

    By inversion over the support, or over nine standard deviations about the mean where the support is wider (what is
    left out has a probability below 1e-17); terms come from their ratios.
    """
    real = lambda c: c.cast("double")
    some = lambda c: F.greatest(c, F.lit(1.0))

    def bounds(v: Column) -> Column:
        pop, good, draws = v["pop"], v["good"], v["draws"]
        mean = real(draws) * real(good) / some(real(pop))
        variance = mean * (1 - real(good) / some(real(pop))) * real(pop - draws) / some(real(pop) - 1)
        spread = F.sqrt(F.greatest(variance, F.lit(0.0))) * 9 + 2
        lo = F.greatest(F.lit(0).cast("long"), draws + good - pop, F.floor(mean - spread))
        hi = F.greatest(lo, F.least(draws, good, F.ceil(mean + spread)))
        return F.struct(pop.alias("pop"), good.alias("good"), draws.alias("draws"), v["u"].alias("u"), lo.alias("lo"), F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(_no_longs()).alias("steps"))

    def inverse(v: Column) -> Column:
        ratio = lambda k: real(v["good"] - k + 1) * real(v["draws"] - k + 1) / (real(k) * some(real(v["pop"] - v["good"] - v["draws"] + k)))
        grow = lambda s, k: let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["total"] + w).alias("total")))
        total = F.aggregate(v["steps"], F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("total")), grow)["total"]

        def find(wanted: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("total"), v["lo"].alias("at"))
            move = lambda s, k: let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["total"] + w).alias("total"), F.when(s["total"] <= wanted, k).otherwise(s["at"]).alias("at")))
            return F.aggregate(v["steps"], begin, move)["at"]

        return let(v["u"] * total, find)

    return let(let(F.struct(pop.alias("pop"), good.alias("good"), draws.alias("draws"), u.alias("u")), bounds), inverse)


def uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a permutation of 0 .. n-1 that the key fixes.

    Rounds of a Feistel network over two digits, whose range is larger than n by less than its root; a number that falls
    outside is permuted again, which leads back in.
    """
    base = F.ceil(F.sqrt(n.cast("double")))
    rows = F.ceil(n / base)

    def once(v: Column) -> Column:
        def turn(digits: Column, i: int) -> Column:
            if i == ROUNDS:
                return digits["hi"] * rows + digits["lo"]
            hi = F.pmod(digits["hi"] + F.pmod(F.xxhash64(*key, F.lit(2 * i), digits["lo"]), base), base)
            low = lambda h: F.pmod(digits["lo"] + F.pmod(F.xxhash64(*key, F.lit(2 * i + 1), h), rows), rows)
            return let(hi, lambda h: let(F.struct(h.alias("hi"), low(h).alias("lo")), lambda d: turn(d, i + 1)))

        return let(F.struct(F.floor(v / rows).alias("hi"), F.pmod(v, rows).alias("lo")), lambda d: turn(d, 0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def shards_for(n_words: int) -> int:
    """A power of two that grows with the words."""
    return max(SHARDS, 1 << max(0, math.ceil(math.log2(max(1, n_words / SHARD_WORDS)))))


def block_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, pass_blocks, passes, missing, rest, whole_blocks, rest_blocks): blocks of a pass, whole passes, words that the
    last block lacks, words to take in one more pass, and the quotas of blocks. The last quota holds enough words whether or
    not the short block is among them.
    """
    size, take = F.col("source_size"), F.col("take")
    rows = targets.select("source_no", "source_size", "take", F.ceil(size / block_words).alias("pass_blocks"), F.when(size > 0, F.floor(take / size)).otherwise(F.lit(0)).cast("long").alias("passes"))
    rows = rows.withColumns({"missing": F.col("pass_blocks") * block_words - size, "rest": take - F.col("passes") * size})
    rest_blocks = F.when(F.col("rest") > 0, F.ceil((F.col("rest") + F.col("missing")) / block_words)).otherwise(F.lit(0)).cast("long")
    return rows.select("source_no", "pass_blocks", "passes", "missing", "rest", (F.col("passes") * F.col("pass_blocks")).alias("whole_blocks"), rest_blocks.alias("rest_blocks"))


def shard_draws(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`quotas` with whole_ends (array<long>, as `shard_quotas` gives them), pools (array of a struct a shard: where its pool of the
    last pass starts, its blocks drawn before and its own) and last_rank, the place of the source's short block among those drawn."""
    kinds = quotas.select(F.explode(F.array(*[F.struct((F.col("source_no") * 2 + k).alias("source_no"), F.col(c).alias("n_blocks")) for k, c in enumerate(("whole_blocks", "rest_blocks"))])).alias("q")).select("q.*")
    ends = written(shard_quotas(kinds, shards, seed))
    of_kind = lambda k, name: ends.filter(F.col("source_no") % 2 == k).select(F.floor(F.col("source_no") / 2).alias("source_no"), F.col("ends").alias(name))
    rows = quotas.join(of_kind(0, "whole_ends"), "source_no").join(of_kind(1, "rest_ends"), "source_no")
    spare, n = F.col("pass_blocks") - F.col("rest_blocks"), F.size("rest_ends")

    def pool(end: Column, j: Column) -> Column:
        first = F.when(j == 0, F.lit(0).cast("long")).otherwise(F.get("rest_ends", j - 1))
        return F.struct((first + F.floor(spare * j / n)).alias("start"), first.alias("first"), (end - first).alias("n"))

    rows = rows.withColumn("pools", F.transform("rest_ends", pool)).drop("rest_ends")
    last = let(permuted(F.col("pass_blocks") - 1, F.col("pass_blocks"), *block_key(seed)), lambda p: drawn_at(p)["rank"])
    return rows.withColumn("last_rank", F.when(F.col("rest_blocks") > 0, last))


def drawn_at(place: Column) -> Column:
    """(shard, rank) of the pool that a place of the last pass is in: rank among all blocks drawn, null if the shard doesn't draw it."""
    rank = lambda p: F.when(place - p["start"] < p["n"], p["first"] + place - p["start"])
    of = lambda k: let(F.element_at("pools", k), lambda p: F.struct((k - 1).alias("shard"), rank(p).alias("rank")))
    return let(F.size(F.filter("pools", lambda p: p["start"] <= place)), of)


def block_key(seed: int) -> list[Column]:
    return [F.lit(seed), F.col("source_no")]


def _total(q: str | Column) -> Column:
    return F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)


def _drawn(q: Column, draws: Column, *key: Column) -> Column:
    """Of each number in the array q, how many are among `draws` drawn without replacement, one given what those before it took."""

    def step(s: Column, x: Column) -> Column:
        k = hypergeometric(s["pop"], x, s["draws"], uniform(*key, F.size(s["left"])))
        return let(k, lambda k: F.struct((s["pop"] - x).alias("pop"), (s["draws"] - k).alias("draws"), F.concat(s["left"], F.array(k)).alias("left")))

    return F.aggregate(q, F.struct(_total(q).alias("pop"), draws.alias("draws"), _no_longs().alias("left")), step)["left"]


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(source_no, ends array<long>): source's blocks of permuted number below ends[j], from ends[j-1] on, go to shard j.

    Levels of the tree are steps of the plan; a node is one row with the quotas of all sources, in chunks of `chunk`. A
    node's draws are first split among its chunks, then within each chunk among its sources, one given what those before took.
    """
    depth = max(0, math.ceil(math.log2(shards)))
    items = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "n_blocks"))), lambda x: x["n_blocks"])
    parts = quotas.groupBy(F.floor(F.col("source_no") / chunk).alias("chunk")).agg(items.alias("q"))
    nodes = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "q"))), lambda x: x["q"]).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    for level in range(depth):
        sums = F.transform("q", _total)
        tops = nodes.withColumn("draws", _drawn(sums, F.floor(_total(sums) / 2), F.lit(seed), F.lit(-1), F.col("node")))
        halves = tops.withColumn("left", F.transform("q", lambda q, i: _drawn(q, F.get("draws", i), F.lit(seed), i, F.col("node"))))
        right = F.zip_with("q", "left", lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
        nodes = halves.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("n")).select("n.*")
        if level % LEVELS == LEVELS - 1 or level == depth - 1:
            nodes = written(nodes)
    leaf = nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.posexplode("q").alias("chunk", "q")).select("shard", "chunk", F.posexplode("q").alias("place", "n"))
    dealt = leaf.groupBy((F.col("chunk").cast("long") * chunk + F.col("place")).alias("source_no")).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("quota"))
    running = F.aggregate("quota", F.struct(F.lit(0).cast("long").alias("sum"), _no_longs().alias("ends")), lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.concat(s["ends"], F.array(s["sum"] + x["n"])).alias("ends")))
    return dealt.select("source_no", running["ends"].alias("ends"))


def placed(rows: DataFrame, sizes: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """(doc_id, source, source_no, size, h, source_size, target, take, at) and what else `rows` have: `at` is the document's first word in its source's order.

    `rows` are `sizes` or have their columns and more; the sums of the buckets come from `sizes`.
    """
    small = broadcast_if(targets, n_sources, MAX_BROADCAST).withColumnRenamed("source", "_source")

    def in_buckets(rows: DataFrame) -> DataFrame:
        rows = rows.join(small, rows["source"].eqNullSafe(F.col("_source"))).drop("_source", "n_docs")
        return rows.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets"))).drop("buckets")

    sums = in_buckets(sizes).groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    rows = in_buckets(rows)
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    return rows.join(sums, ["source_no", "bucket"]).withColumn("at", F.col("base") + F.col("ahead")).drop("base", "ahead")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, slices), one row a document.

    slices: array<struct<epoch, block, shard, order_key, start, length>>, the word ranges [start, start + length) that the
    mix takes of it; `order_key` orders a shard's blocks, `block` is a number within the source. Without `shards` their
    number follows the words.
    """
    sizes = written(sized(docs, id_column, source_column, text_column, seed))
    targets = written(source_targets(sizes, weights, share, max_epochs))
    shards = shards or shards_for(words_to_take(targets))
    rows = dealt_slices(sizes, sizes, targets, max_epochs, shards, block_words, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "slices")


def words_to_take(targets: DataFrame) -> int:
    return targets.agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]


def dealt_slices(rows: DataFrame, sizes: DataFrame, targets: DataFrame, max_epochs: int, shards: int, block_words: int, seed: int) -> DataFrame:
    """What `placed` gives, with `slices`: what the shards draw of a document's blocks."""
    n_sources = targets.count()
    draws = written(shard_draws(written(block_quotas(targets, block_words)), shards, seed))
    rows = placed(rows, sizes, targets, n_sources).join(broadcast_if(draws, n_sources * shards, MAX_DRAWS), "source_no")
    lo, hi = F.col("at"), F.col("at") + F.col("size")
    blocks = F.sequence(F.floor(lo / block_words), F.floor((hi - 1) / block_words))

    def drawn(epoch: int) -> Column:
        """Slices of one pass through the source."""

        def cut(b: Column, shard: Column, upto: Column | int) -> Column:
            start, end = F.greatest(lo, b * block_words), F.least(hi, b * block_words + upto)
            block = F.lit(epoch) * F.col("pass_blocks") + b
            return F.struct(F.lit(epoch).alias("epoch"), block.alias("block"), shard.alias("shard"), F.xxhash64(F.lit(seed), "source_no", block).alias("order_key"), (start - lo).alias("start"), (end - start).alias("length"))

        def of_whole(b: Column) -> Column:
            number = permuted(F.lit(epoch) * F.col("pass_blocks") + b, F.col("whole_blocks"), F.lit("shard"), *block_key(seed))
            return cut(b, let(number, lambda p: F.size(F.filter("whole_ends", lambda e: e <= p))), block_words)

        def of_rest(b: Column) -> Column:
            def told(d: Column) -> Column:
                before = d["rank"] * block_words - F.when(F.col("last_rank") < d["rank"], F.col("missing")).otherwise(F.lit(0))
                upto = F.when(d["rank"].isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(block_words), F.col("rest") - before)))
                return cut(b, d["shard"], upto)

            return let(let(permuted(b, F.col("pass_blocks"), *block_key(seed)), drawn_at), told)

        some = lambda s: s["length"] > 0
        whole, rest = F.col("passes") > epoch, (F.col("passes") == epoch) & (F.col("rest_blocks") > 0)
        return F.when((F.col("size") > 0) & whole, F.transform(blocks, of_whole)).when((F.col("size") > 0) & rest, F.filter(F.transform(blocks, of_rest), some))

    slices = F.flatten(F.array_compact(F.array(*[drawn(e) for e in range(max_epochs)])))
    return rows.withColumn("slices", slices)


def taken(mixed: DataFrame) -> DataFrame:
    """The words taken of each document."""
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.aggregate("slices", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each slice that `mix` takes, cut to its words.

    Rows come shard after shard, and within a shard by `order_key`: a partition holds a range of one shard's order keys, for
    about `part_words` words. Rows are shuffled twice, to their places in the sources' orders and to their shards.
    """
    names = docs.columns
    sizes = written(sized(docs, seed=seed))
    targets = written(source_targets(sizes, weights, share, max_epochs))
    n_words = words_to_take(targets)
    shards = shards or shards_for(n_words)
    parts = max(1, math.ceil(n_words / shards / part_words))
    rows = dealt_slices(sized(docs, seed=seed, whole=True), sizes, targets, max_epochs, shards, block_words, seed)
    text = F.col("row.text")

    def cut(words: Column) -> Column:
        part = lambda s: F.when(s["length"] == F.col("size"), text).otherwise(F.array_join(F.slice(words, s["start"].cast("int") + 1, s["length"].cast("int")), ""))
        return F.transform("slices", lambda s: F.struct(s.alias("slice"), part(s).alias("text")))

    whole = F.forall("slices", lambda s: s["length"] == F.col("size"))
    uncut = F.transform("slices", lambda s: F.struct(s.alias("slice"), text.alias("text")))
    # Words are found once a document, and only where one is cut.
    pieces = F.when(whole, uncut).otherwise(let(F.regexp_extract_all(text, F.lit(f"({WORD})[\\x20\\x09-\\x0D]*"), F.lit(0)), cut))
    rows = rows.withColumn("piece", F.explode(pieces))
    place = F.col("piece.slice.order_key")
    range_ = F.least(F.lit(parts - 1), F.floor((place.cast("double") / float(1 << 64) + 0.5) * parts)).cast("int")
    values = {c: F.col(f"row.`{c}`") for c in names} | {"text": F.col("piece.text")}
    if "n_chars" in names:
        is_part = F.col("piece.slice.length") != F.col("size")
        values["n_chars"] = F.when(is_part, F.char_length("piece.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    position = F.col("at") + F.col("piece.slice.epoch") * F.col("source_size") + F.col("piece.slice.start")
    out = rows.select(
        F.struct(*(v.alias(c) for c, v in values.items())).alias("row"),
        (F.col("piece.slice.shard") * parts + range_).cast("int").alias("part"),
        place.alias("order_key"),
        "source_no",
        position.alias("position"),
    )
    leaves = 1 << max(0, math.ceil(math.log2(shards)))
    return out.repartitionById(leaves * parts, "part").sortWithinPartitions("order_key", "source_no", "position").select("row.*")
