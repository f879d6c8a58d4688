"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret removal, packing.

Each stage gets all rows that its predecessor kept. The first four return the columns of ``documents``; the last returns the
packed pieces. Between stages the rows are written as Parquet to the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tanteo.llm import best_fit_packing, decontamination, ngram_join, quality_rules, secrets
from tanteo.llm.store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express the tokenizer and the latent search; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from tanteo.llm.queries import ship

        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark (``n_chars`` stays that of the original)."""
    return secrets.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where its tokens lie in the packed sequences."""
    return best_fit_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    (name, _shipped(stage)) for name, stage in (
        ("quality_rules", quality), ("ngram_join", near_duplicates), ("decontamination", benchmark), ("secrets", secret_removal), ("packing", packing),
    )
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
