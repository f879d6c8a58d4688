"""Published fixtures: identity of a match-up and which publication of it counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions.text import is_blank, normalize_key, strip_edges
from tanteo.operators.quality import SOURCE_TYPES
from tanteo.operators.ranking import packed_first, row_mark

NORMAL, RESCHEDULED = SOURCE_TYPES


def identified(publications: DataFrame) -> DataFrame:
    """Add ``scope`` (match-up identity), ``kind``, ``schedule`` and ``error`` to published fixtures.

    The identity is both team ids when resolved, else branch, category, division, clubs and team letters. Every text is
    normalised once, in its own step, and the rules then compare the results.
    """
    parsed = publications.withColumns(
        {
            "_home_id": _positive("local_equipo_id"),
            "_away_id": _positive("visitante_equipo_id"),
            "_branch": F.upper(F.trim(F.col("rama"))),
            "_home_code": _code("local_equipo_codigo"),
            "_away_code": _code("visitante_equipo_codigo"),
            "kind": F.trim(F.col("tipo_fuente")),
            "schedule": schedule_key(),
            **{f"_{c}": normalize_key(F.col(c)) for c in ("categoria", "division", "local", "visitante")},
        }
    )
    home, away = F.col("_home_id"), F.col("_away_id")
    by_ids = F.concat_ws("|", F.lit("ids"), home.cast("string"), away.cast("string"))
    by_names = F.concat_ws(
        "|", F.lit("scope"), "_branch", "_categoria", "_division", "_local", "_home_code", "_visitante", "_away_code"
    )
    keyed = parsed.withColumn("_error", _identity_error())
    scope = F.when(F.col("_error").isNull(), F.when(home.isNotNull(), by_ids).otherwise(by_names))
    outcome = F.struct(
        scope.alias("scope"), "kind", "schedule", F.coalesce("_error", _publication_error()).alias("error")
    )
    # A generator of one row: filters on its output stay above it, so the keys are computed once per publication.
    return keyed.select(*publications.columns, F.inline(F.array(outcome)))


def _positive(column: str) -> Column:
    number = F.trim(F.col(column).cast("string")).try_cast("bigint")
    return F.when(number > 0, number)


def _code(column: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(column), F.lit("A"))))


def schedule_key() -> Column:
    """Date and clock time of a publication, or its date with a marker when the time is unknown."""
    time = F.substring(F.trim(F.coalesce(F.col("hora"), F.lit(""))), 1, 5)
    return F.concat_ws("|", F.trim(F.col("fecha")), F.coalesce(F.nullif(time, F.lit("")), F.lit("sin-hora")))


def _first_broken(rules: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(bad, message) for bad, message in rules])


def _missing(column: str) -> tuple[Column, Column]:
    return is_blank(strip_edges(F.col(column).cast("string"))), F.lit(f"Fixture sin {column}")


def _identity_error() -> Column:
    """First structural problem of a publication's identity, null when there is none."""
    home, away = F.col("_home_id"), F.col("_away_id")
    named = home.isNull() & away.isNull()
    home_key, away_key = F.col("_local"), F.col("_visitante")
    return _first_broken(
        [
            *map(_missing, ("categoria", "division", "rama")),
            (~F.col("_branch").isin("M", "F"), F.concat(F.lit("Rama inválida: "), F.col("_branch"))),
            (home.isNull() != away.isNull(), F.lit("Fixture con un solo equipo_id resuelto")),
            (home == away, F.lit("Local y visitante no pueden ser el mismo equipo")),
            *[(named & bad, message) for bad, message in map(_missing, ("local", "visitante"))],
            (
                named & ((home_key == "") | (away_key == "") | (home_key == away_key)),
                F.lit("Clubes local/visitante inválidos"),
            ),
            (named & ((F.col("_home_code") == "") | (F.col("_away_code") == "")), F.lit("Fixture sin equipo_codigo")),
        ]
    )


def _publication_error() -> Column:
    """Problems of the source type and the date."""
    return _first_broken(
        [
            _missing("tipo_fuente"),
            (~F.col("kind").isin(*SOURCE_TYPES), F.concat(F.lit("tipo_fuente inválido: "), F.col("kind"))),
            _missing("fecha"),
        ]
    )


class Prioritized(NamedTuple):
    """``rejected`` must be empty before anything is written: one bad publication blocks the load."""

    selected: DataFrame
    ambiguous: DataFrame
    rejected: DataFrame


def distinct_schedules(publications: DataFrame, *keys: str) -> DataFrame:
    """The mark of the first publication of each schedule inside its match-up and source type, its ``seq``, and how many repeat it."""
    found = publications.groupBy(*keys).agg(F.min("mark").alias("first"), F.count("*").alias("versions"))
    return found.withColumn("seq", packed_first(F.col("first")))


def marked(publications: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Publications with ``mark``, by which the first one is chosen and found again: ``seq``, and a digest for those that share it."""
    return publications.withColumn("mark", row_mark(F.col("seq"), *columns))


def prioritize(publications: DataFrame) -> Prioritized:
    """Choose one publication per match-up; ``seq`` is the order of publication, not negative.

    A single rescheduling wins, several are ambiguous; without one, a single normal date wins. Repeats are merged by
    partial aggregation twice, so a match-up published very often never meets in one task. Only numbers are aggregated; what a
    winner says is joined back by its mark.
    """
    checked = identified(publications)
    rejected = checked.where("error is not null").select(*publications.columns, "error")
    columns = publications.columns
    valid = marked(checked.where("error is null").drop("error"), columns)
    schedules = distinct_schedules(valid, "scope", "kind", "schedule")
    normal, moved = F.col("kind") == NORMAL, F.col("kind") == RESCHEDULED
    matchups = schedules.groupBy("scope").agg(
        F.count_if(normal).alias("normals"),
        F.count_if(moved).alias("moves"),
        F.sum("versions").alias("versiones_detectadas"),
        F.min(F.when(normal, F.col("first"))).alias("normal"),
        F.min(F.when(moved, F.col("first"))).alias("moved"),
    )
    ambiguity = F.when(F.col("moves") > 1, "multiples_reprogramaciones").when(
        (F.col("moves") == 0) & (F.col("normals") > 1), "mismo_cruce_repetido"
    )
    matchups = matchups.withColumn("tipo", ambiguity)
    by_move = F.col("moves") == 1
    winners = matchups.where("tipo is null").select(
        "scope",
        F.when(by_move, F.col("moved")).otherwise(F.col("normal")).alias("mark"),
        F.when(by_move, RESCHEDULED).otherwise(NORMAL).alias("fuente_priorizada"),
        "versiones_detectadas",
        F.when(by_move & (F.col("normals") == 1), F.col("normal")).alias("_original"),
    )
    # Equal publications share a mark: one of them is enough.
    published = marked(publications, columns)
    before = published.where(F.trim(F.col("tipo_fuente")) == NORMAL).select(
        F.col("mark").alias("_original"), F.col("fecha").alias("fecha_programacion_original"),
        F.col("hora").alias("hora_programacion_original"),
    )
    # No mark is negative: winners without an original find none, and do not meet in one task as equal nulls would.
    nothing = -1 - F.xxhash64("scope").bitwiseAND(F.lit((1 << 62) - 1))
    winners = winners.withColumn("_original", F.coalesce("_original", nothing.cast("decimal(38,0)")))
    selected = winners.join(published, "mark").join(before, "_original", "left").select(
        "scope", *columns, "fuente_priorizada", "versiones_detectadas", "fecha_programacion_original", "hora_programacion_original",
    ).distinct()
    ambiguous = matchups.where("tipo is not null").select("scope", "tipo", "versiones_detectadas")
    return Prioritized(selected, ambiguous, rejected)


def ambiguous_versions(publications: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Every publication of the ambiguous match-ups."""
    keyed = identified(publications).where("error is null").select(*publications.columns, "scope")
    return keyed.join(ambiguous.select("scope", "tipo"), "scope")


def identification_coverage(publications: DataFrame) -> DataFrame:
    """Share of publications with both teams identified; writing is allowed only at 100 %."""
    resolved = _positive("local_equipo_id").isNotNull() & _positive("visitante_equipo_id").isNotNull()
    counted = publications.agg(F.count("*").alias("total"), F.count_if(resolved).alias("identified"))
    tenths = F.when(F.col("total") > 0, F.floor(F.col("identified") * 1000 / F.col("total")))
    return counted.select(
        "total", "identified", (tenths / F.lit(10.0)).alias("coverage_pct"),
        (F.col("identified") == F.col("total")).alias("write_allowed"),
    )


def volume_baseline(received: DataFrame, stored: DataFrame, tolerance_pct: int = 5) -> DataFrame:
    """Fixtures received against matches stored per season, flagged when they differ by more than the tolerance."""
    counts = [
        df.groupBy("temporada_id").agg(F.count("*").alias(name)) for df, name in ((received, "received"), (stored, "expected"))
    ]
    gap = F.abs(F.col("received") - F.col("expected"))
    return (
        counts[0]
        .join(counts[1], "temporada_id", "full")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("received", "expected")})
        .withColumn("alert", gap * 100 > F.col("expected") * tolerance_pct)
    )
