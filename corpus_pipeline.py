"""From documents to packed sequences: grade, check by rules, drop near-duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages a table is written and read again, in the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.llm import mixing, packing, quality_classifier, quality_rules, simhash
from skewline.llm.common import written
from skewline.llm.queries import VOCABULARY

#: No SQL says what the fitted models keep; tests hold the stages against brute force.
ORACLE_SQL = None


def kept_rows(docs: DataFrame, verdict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `docs` whose verdict is true, told from the rows themselves: the whole row travels as the id, so nothing is joined."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return verdict(whole).filter("kept").select("doc_id.*")


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; fitted on the labelled ones among `docs`."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept_rows(docs, lambda d: quality_classifier.graded(d, model, id_column="row"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; fitted on the labelled ones of the corpus, since few bad ones are left here."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = quality_rules.fit(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept_rows(docs, lambda d: quality_rules.quality_rules(d, trees, id_column="row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences."""
    pieces = packing.token_pieces(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, docs.count())


STAGES = [
    ("quality classifier", grade),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
