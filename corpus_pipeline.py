"""The documents table made ready for training, stage by stage, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silverprint.llm import decontaminate, near_dups, quality_rank, surrogates, word_bpe
from silverprint.llm.queries import SURROGATE_KEY, vocabulary
from silverprint.workspace import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts below its cut go."""
    ranking = quality_rank.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rank.keep_good(docs, ranking)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; documents without id stay."""
    repeats = near_dups.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(repeats, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that mostly consists of them goes."""
    return decontaminate.cut_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return surrogates.replace_personal_data(docs, SURROGATE_KEY).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the length and digests that show their exact round trip."""
    return word_bpe.digests(docs, vocabulary("word_bpe_49k.json"), stored=True)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: Trained scores, automata and keyed surrogates cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a stored table before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
