"""Fixture batches: a JSON array of flat objects per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.functions.dates import clock, iso_date
from tanteo.functions.text import null_if_blank

# Keys of a published fixture; every value is read as text and cast afterwards.
PAYLOAD_KEYS = (
    "temporada_id", "competencia_id", "fecha", "hora", "jornada", "local_equipo_id", "visitante_equipo_id",
    "programacion_url", "programacion_pdf_url", "tipo_fuente", "observaciones",
)
PAYLOAD_SCHEMA = "array<struct<" + ",".join(f"{key}:string" for key in PAYLOAD_KEYS) + ">>"


def batch_sizes(batches: DataFrame) -> DataFrame:
    """Length of each batch's array, null when the payload is not a JSON array."""
    return batches.select("batch_id", F.json_array_length("payload").cast("bigint").alias("total"))


def fixture_rows(batches: DataFrame) -> DataFrame:
    """Elements of every array with their 1-based index, as text in ``raw`` and typed beside it."""
    return typed_rows(
        batches.where(F.json_array_length("payload").isNotNull()).select(
            "batch_id", F.posexplode(F.from_json("payload", PAYLOAD_SCHEMA)).alias("position", "raw")
        ).withColumn("idx", F.col("position").cast("bigint") + 1)
    )


def typed_rows(rows: DataFrame) -> DataFrame:
    def text(key: str):
        return null_if_blank(F.col(f"raw.{key}"))

    return rows.select(
        "batch_id",
        "idx",
        "raw",
        *[text(k).try_cast("bigint").alias(k) for k in
          ("temporada_id", "competencia_id", "local_equipo_id", "visitante_equipo_id")],
        iso_date(text("fecha")).alias("fecha"),
        clock(text("hora")).alias("hora"),
        text("jornada").try_cast("int").alias("jornada"),
        *[text(k).alias(k) for k in ("tipo_fuente", "programacion_url", "programacion_pdf_url")],
        F.nullif(F.col("raw.observaciones"), F.lit("")).alias("observaciones"),
    )
