"""The queries opN_<name> and pipeline: thin uses of the operators with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenization import MAX_TOKENS, token_counts

    counts = token_counts(read(spark, sf_dir, "documents"), VOCABULARY)
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_tree import extract

    return extract(read(spark, sf_dir, "pages"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k, whole_numbers

    rows = whole_numbers(read(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    return taken(mix(read(spark, sf_dir, "documents"))).drop("source")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, prefix_targets

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(prefix_targets(turns.unionByName(probe)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    docs = read(spark, sf_dir, "documents")
    pieces = token_pieces(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, docs.count())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, quality_rules

    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, read(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, graded

    docs = read(spark, sf_dir, "documents")
    return graded(docs, fit(docs, read(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenth of the documents, told by their ids, the words from a place on repeat with a period; then all are scanned."""
    from .mixing import word_count
    from .periodic_runs import best_run, periodic_runs, repeated_tail

    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), word_count("text")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    text = F.when((h % 10 == 0) & (n > 0), repeated_tail(F.col("text"), a, p)).otherwise(F.col("text"))
    runs = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_documents, write_tokens

    rows = read_documents(write_tokens(read(spark, sf_dir, "documents"), BYTE_VOCABULARY))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import folded, leaf, merkle, proof

    told = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaves = read(spark, sf_dir, "documents").select("doc_id", "lang", told(F.col("n_chars")).alias("leaf"), F.when(tampered, told(F.col("n_chars") + 1)).alias("_tampered"))
    rows = merkle(leaves, "leaf", "lang", "doc_id")
    rows = rows.withColumn("folded_root", folded(F.coalesce("_tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_token_counts": op2_token_counts,
        "op3_html_extraction": op3_html_extraction,
        "op4_top_k": op4_top_k,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_mixing": op6_mixing,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_token_files": op12_token_files,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


#: Exact top-k over all pairs, for small tables.
SQL_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

#: Digests from the turns themselves, and the length of the formatted examples from the lengths of their turns.
SQL_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS t2,
  regexp_replace(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS r2 FROM c),
f AS (SELECT *, length(r2) + 1 + length(t2) + CASE WHEN role = 'assistant' THEN 7 ELSE 20 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto, lead(conv_id) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars FROM g GROUP BY conv_id"""

#: The reversed CRC-32 polynomial's remainders of four bits (fixed values).
CRC_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"

#: Trees level by level; a proof's steps are the neighbours of a leaf's ancestors, and folding goes up step by step.
SQL_MERKLE = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, * FROM documents),
fields AS (SELECT r, g, doc_id, n, tampered, [doc_id::VARCHAR, source, lang, n::VARCHAR, text] AS f FROM (SELECT *, false AS tampered, n_chars AS n FROM rows UNION ALL SELECT *, true, n_chars + 1 FROM rows)),
told AS (SELECT r, g, doc_id, tampered, sha256(array_to_string(list_transform(f, lambda x: CASE WHEN x IS NULL THEN '-' ELSE octet_length(encode(x)) || ':' || x END), '')) AS d FROM fields),
crc AS (SELECT r, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c) & 15, ord(c) >> 4]))),
  lambda c, x: xor(c >> 4, {CRC_NIBBLES}[(xor(c, x) & 15) + 1]))) AS h FROM rows),
leaves AS (SELECT a.r, a.g, a.doc_id, a.d, CASE WHEN a.doc_id IS NOT NULL AND h % 7 = 0 THEN b.d ELSE a.d END AS d2, row_number() OVER (PARTITION BY a.g ORDER BY a.doc_id NULLS FIRST, a.d) - 1 AS i, count(*) OVER (PARTITION BY a.g) AS m
  FROM told a JOIN told b USING (r) JOIN crc USING (r) WHERE NOT a.tampered AND b.tampered),
up AS (SELECT g, 0 AS level, i, m, d FROM leaves UNION ALL SELECT g, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE m > 1 GROUP BY g, level, i // 2, m),
sub AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM up WHERE m = 1),
up2 AS (SELECT 0 AS level, i, m, d FROM sub UNION ALL SELECT level + 1, i // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up2 WHERE m > 1 GROUP BY level, i // 2, m),
steps AS (SELECT r, 0 AS tree, u.level, (l.i >> u.level) % 2 = 1 AS is_right, s.d AS s FROM leaves l JOIN up u ON u.g = l.g AND u.m > 1 AND u.i = l.i >> u.level LEFT JOIN up s ON s.g = l.g AND s.level = u.level AND s.i = xor(u.i, 1)
  UNION ALL SELECT r, 1, u.level, (b.i >> u.level) % 2 = 1, s.d FROM leaves l JOIN sub b ON b.g = l.g JOIN up2 u ON u.m > 1 AND u.i = b.i >> u.level LEFT JOIN up2 s ON s.level = u.level AND s.i = xor(u.i, 1)),
path AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY tree, level) - 1 AS k, is_right, coalesce(s, '') AS s FROM steps),
fold AS (SELECT r, 0 AS k, d2 AS d FROM leaves UNION ALL SELECT r, f.k + 1, sha256(CASE WHEN is_right THEN s || d ELSE d || s END) FROM fold f JOIN path p USING (r) WHERE p.k = f.k),
ends AS (SELECT r, max_by(d, k) AS d FROM fold GROUP BY r), proofs AS (SELECT r, sha256(string_agg(s, '' ORDER BY k)) AS p FROM path GROUP BY r)
SELECT l.doc_id, l.d AS leaf, sub.d AS subroot, u.d AS root, coalesce(p, sha256('')) AS proof_sha256, ends.d AS folded_root, ends.d = u.d AS verified
FROM leaves l JOIN sub USING (g) JOIN ends USING (r) JOIN up2 u ON u.m = 1 LEFT JOIN proofs USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The others fit models, tokenize, hash or extract in ways that SQL has no functions for; tests hold them against brute force."""
    return {"op4_top_k": SQL_TOP_K, "op7_chat_formatting": SQL_CHAT, "op13_merkle_manifest": SQL_MERKLE}
