"""From raw documents to packed sequences: quality rules, near duplicates, decontamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir); run() writes what it returns and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import common, decontaminate, jaccard, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays: that of the smallest id.

    Rows without an id stay. Of rows that share an id and the whole text, one stays; other rows that share an id are told
    apart by nothing that later stages have, so they stay or go together.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    groups = jaccard.similar_groups(docs, 5, 80, 100).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(groups, docs["doc_id"].cast("long") == groups["__gone"], "left_anti").select(*own)
    several = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__several"))
    if several.isEmpty():
        return kept
    same = kept["doc_id"] == several["__several"]
    return kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; all documents stay."""
    import public_tokenizers

    return secrets.redact(docs, "text", "n_chars" if "n_chars" in docs.columns else None, public_tokenizers.path("byte_bpe_50k.json"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences and places."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Repetition hashes, suffix arrays, compression and tokenization are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir))
    return docs
