"""Registered queries of this package: each applies one operator to a whole table and returns its full result."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tanteo.llm import (
    best_fit_packing, decontamination, html_text, ngram_join, phrases, quality_rules, secrets, simhash, spelling, store,
    substring_dedup, token_output, toxicity, url_filters,
)
from tanteo.llm import sql as oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_quality_rules": oracle.QUALITY_RULES, "op5_ngram_join": oracle.NGRAM_JOIN, "op11_phrases": oracle.PHRASES,
    "op13_spelling": oracle.SPELLING,
}

URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they then need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "tanteo_llm_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "tanteo").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def query(name: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder)

        QUERIES[name] = run
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *quality_rules.BASE, failed.alias("base_failed"), "kept")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, folder, "documents"))


@query("op3_html_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scanned(table(spark, folder, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of(kind) for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


@query("op5_ngram_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


@query("op6_token_output")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = token_output.sequences(table(spark, folder, "documents"))
    return found.select(
        "shard", "sequence", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts", "n_tokens",
    )


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    # a document with two labels counts as toxic if one of them says so
    labels = table(spark, folder, "labels").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = store.stored(toxicity.chosen(docs.select("doc_id"), labels))
    lexicon = toxicity.fit(store.stored(docs.join(F.broadcast(chosen), "doc_id")))
    return toxicity.scored(docs, lexicon).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.marked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.cosine", "leak.common", "leak.start")


@query("op9_substring_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return found.where((F.size("spans") > 0) | (F.col("n_first_words") > 0) | F.col("copy_of").isNotNull())


@query("op10_url_filters")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judged(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op11_phrases")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mined(table(spark, folder, "documents"))


@query("op12_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.linked(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "fingerprint", "component_id")


@query("op13_spelling")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(spelling.misspelled(table(spark, folder, "documents"), every=31))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
