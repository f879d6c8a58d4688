"""Fixture import: check every batch, then apply the accepted ones to the matches in one set-based step."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions.text import fingerprint, null_if_blank
from tanteo.operators.quality import SOURCE_TYPES
from tanteo.operators.ranking import ranked
from tanteo.schemas import PARTIDOS
from tanteo.session import cut
from tanteo.sources.payload import batch_sizes, fixture_rows

PAIR = ("temporada_id", "local_equipo_id", "visitante_equipo_id")
# Review kinds and their notes.
REVIEW_MOVED = "partido_finalizado_fecha_distinta"
REVIEW_AMBIGUOUS = "partido_cruce_ambiguo"
REVIEW_ERROR = "error_sync_partido"
MOVED_NOTE = "La programación difiere de un partido ya no programado; no se modificó automáticamente."
AMBIGUOUS_NOTE = "Existen %s partidos con el mismo cruce en la temporada; no se modificó automáticamente."
PENDING = "pendiente"


def _raw(key: str) -> Column:
    return null_if_blank(F.col(f"raw.{key}"))


def _unreadable(key: str, typed: str | None = None) -> Column:
    return _raw(key).isNotNull() & F.col(typed or key).isNull()


def preflight_rows(rows: DataFrame, temporadas: DataFrame, equipos: DataFrame) -> DataFrame:
    """First rule each fixture breaks (null when none), in the fixed order of the rules."""
    seasons = temporadas.select(F.col("id").alias("season"), F.col("competencia_id").alias("season_competition"))
    active = equipos.where("activo")

    def side(prefix: str) -> DataFrame:
        return active.select(
            F.col("id").alias(f"{prefix}_id"),
            F.struct("temporada_id", "categoria", "division", "rama").alias(f"{prefix}_scope"),
        ).hint("shuffle_hash")

    facts = (
        rows.join(seasons, F.col("temporada_id") == F.col("season"), "left")
        .join(side("home"), F.col("local_equipo_id") == F.col("home_id"), "left")
        .join(side("away"), F.col("visitante_equipo_id") == F.col("away_id"), "left")
    )
    home, away, season = F.col("local_equipo_id"), F.col("visitante_equipo_id"), F.col("temporada_id")
    kind = F.col("tipo_fuente")

    def text(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("null"))

    def unlike(part: str) -> Column:
        return ~F.col(f"home_scope.{part}").eqNullSafe(F.col(f"away_scope.{part}"))

    rules: list[tuple[Column, Column | str]] = [
        *[(_unreadable(key), f"{key} inválido")
          for key in ("temporada_id", "competencia_id", "local_equipo_id", "visitante_equipo_id", "fecha")],
        (season.isNull(), "temporada_id requerido"),
        (F.col("competencia_id").isNull(), "competencia_id requerido"),
        (home.isNull() | away.isNull() | (home <= 0) | (away <= 0), "IDs de equipos inválidos"),
        (home == away, "Local y visitante no pueden ser el mismo equipo"),
        (F.col("fecha").isNull(), "fecha requerida"),
        (~F.coalesce(kind.isin(*SOURCE_TYPES), F.lit(False)), F.concat(F.lit("tipo_fuente inválido: "), text(kind))),
        (F.col("programacion_url").isNull(), "programacion_url requerida"),
        (F.col("programacion_pdf_url").isNull(), "programacion_pdf_url requerida"),
        (F.col("season_competition").isNull(), F.concat(F.lit("temporada inexistente: "), text(season))),
        (F.col("competencia_id") != F.col("season_competition"),
         F.concat(F.lit("competencia "), text(F.col("competencia_id")), F.lit(" no corresponde a temporada "), text(season))),
        (F.col("home_id").isNull() | F.col("away_id").isNull(), "equipo inexistente o inactivo"),
        (~F.col("home_scope.temporada_id").eqNullSafe(season) | ~F.col("away_scope.temporada_id").eqNullSafe(season),
         "equipo fuera de temporada"),
        (unlike("categoria") | unlike("division") | unlike("rama"), "cruce entre scopes competitivos distintos"),
        (_unreadable("hora"), "hora inválida"),
    ]
    error = F.coalesce(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in rules])
    return facts.select(*rows.columns, error.alias("error"))


def preflight_errors(checked: DataFrame) -> DataFrame:
    """Broken rows as reported: index, reason and the values that were sent."""
    return checked.where("error is not null").select(
        "batch_id", F.col("idx").alias("indice"), "error",
        *[F.col(f"raw.{k}").alias(k) for k in ("local_equipo_id", "visitante_equipo_id", "fecha")],
    )


def preflight_batches(batches: DataFrame, checked: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Verdict per batch: size guards, broken rows, repeated rows and match-ups with two schedules.

    ``max_rows`` is the size that the receiving side allows for one batch; None allows any.
    """
    time = F.coalesce(F.col("hora"), F.lit("00:00:00"))
    same_row = checked.groupBy("batch_id", *PAIR, "fecha", time.alias("time"), "tipo_fuente").agg(
        F.count("*").alias("n"), F.count("error").alias("broken")
    )
    pairs = same_row.groupBy("batch_id", *PAIR).agg(
        F.sum("broken").alias("broken"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.countDistinct("fecha", "time").alias("schedules"),
    )
    per_batch = pairs.groupBy("batch_id").agg(
        F.sum("broken").alias("broken"),
        F.sum("repeated").alias("repeated"),
        F.count_if(F.col("schedules") > 1).alias("ambiguous"),
    )
    total = F.col("total")
    guard = (
        F.when(total.isNull(), "p_partidos debe ser un array JSON")
        .when(total == 0, "lote vacío")
    )
    if max_rows is not None:
        guard = guard.when(total > max_rows, f"lote excede {max_rows} partidos")
    broken = F.coalesce(F.col("broken"), F.lit(0))

    def when_rows_valid(column: str) -> Column:
        return F.when(F.col("error").isNull() & (F.col("invalidos") == 0), F.col(column)).otherwise(0).cast("bigint")

    verdict = (
        batch_sizes(batches)
        .join(per_batch, "batch_id", "left")
        .withColumn("error", guard)
        .withColumn("invalidos", F.when(guard.isNotNull(), F.lit(1)).otherwise(broken).cast("bigint"))
    )
    verdict = verdict.select(
        "batch_id",
        F.coalesce(total, F.lit(0)).alias("total"),
        "invalidos",
        when_rows_valid("repeated").alias("duplicate_payload_groups"),
        when_rows_valid("ambiguous").alias("ambiguous_schedule_pairs"),
        "error",
    )
    clean = (F.col("invalidos") == 0) & (F.col("duplicate_payload_groups") == 0) & (F.col("ambiguous_schedule_pairs") == 0)
    return verdict.withColumn("ok", clean)


def preflight(
    batches: DataFrame, temporadas: DataFrame, equipos: DataFrame, max_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Verdict per batch and all checked rows, those of batches that are too large as well.

    The checked rows are written once: the verdicts, the error report and the gate all read them.
    """
    checked = cut(preflight_rows(fixture_rows(batches), temporadas, equipos))
    return preflight_batches(batches, checked, max_rows), checked


def gate(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of accepted batches only; a batch enters whole or not at all."""
    return checked.join(verdicts.where("ok").select("batch_id").hint("shuffle_hash"), "batch_id", "left_semi").drop("error")


class SyncResult(NamedTuple):
    decisions: DataFrame
    counters: DataFrame
    matches: DataFrame
    reviews: DataFrame


def sync_decisions(rows: DataFrame, partidos: DataFrame) -> DataFrame:
    """What happens to each accepted row, as if the rows were applied one by one in batch and index order.

    A row of a match-up meets the schedule its predecessor left behind. The predecessor is found by joining on
    position, not by a window over the match-up, so a match-up published in very many batches stays spread.
    """
    stored = partidos.groupBy(*PAIR).agg(
        F.count("*").alias("stored"),
        F.min(F.struct("id", "fecha", "hora", "estado")).alias("match"),
    )
    unreadable = _unreadable("jornada")
    valid = ranked(
        rows.where(~unreadable), list(PAIR), [F.col("batch_id"), F.col("idx")], "turn"
    )
    previous = valid.select(
        *PAIR, (F.col("turn") + 1).alias("turn"), F.struct("fecha", "hora").alias("previous")
    )
    facts = valid.join(stored.hint("shuffle_hash"), list(PAIR), "left").join(previous.hint("shuffle_hash"), [*PAIR, "turn"], "left")
    movable = F.col("stored").isNull() | ((F.col("stored") == 1) & F.coalesce(F.col("match.estado") == "programado", F.lit(False)))
    current = F.when(movable & (F.col("turn") > 1), F.col("previous")).when(
        F.col("stored") == 1, F.struct(F.col("match.fecha").alias("fecha"), F.col("match.hora").alias("hora"))
    )
    facts = facts.withColumn("current", current)
    same = F.col("current.fecha").eqNullSafe(F.col("fecha")) & F.col("current.hora").eqNullSafe(F.col("hora"))
    action = (
        F.when(F.col("stored") > 1, "revision")
        .when(F.col("stored").isNull() & (F.col("turn") == 1), "insertado")
        .when(same, "ya_existente")
        .when(movable, "reprogramado")
        .otherwise("revision")
    )
    decided = facts.withColumn("accion", action).select(
        *rows.columns, "turn", "accion", F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"),
        F.col("match.id").alias("partido_id"), F.col("current.fecha").alias("fecha_anterior"),
        F.col("current.hora").alias("hora_anterior"),
    )
    failed = rows.where(unreadable).withColumn("accion", F.lit("error"))
    return decided.unionByName(failed, allowMissingColumns=True)


def sync_counters(decisions: DataFrame) -> DataFrame:
    """Counters per batch."""
    names = {
        "insertados": "insertado", "ya_existentes": "ya_existente", "reprogramados": "reprogramado",
        "revision": "revision", "errores": "error",
    }
    return decisions.groupBy("batch_id").agg(
        F.count("*").alias("total_recibidos"),
        *[F.count_if(F.col("accion") == action).alias(name) for name, action in names.items()],
    )


def apply_decisions(
    decisions: DataFrame, partidos: DataFrame, run_at: str, source: str = "la federación"
) -> DataFrame:
    """Matches after the load: inserts added, refreshed and rescheduled rows replaced, the rest untouched."""
    written = F.col("accion").isin("insertado", "ya_existente", "reprogramado")
    last = ("fecha", "hora", "programacion_url", "programacion_pdf_url", "tipo_fuente")
    per_pair = (
        decisions.where(written)
        .groupBy(*PAIR)
        .agg(
            F.max(F.struct("turn", *last)).alias("last"),
            F.max(F.when(F.col("jornada").isNotNull(), F.struct("turn", "jornada"))).alias("round"),
            F.max(
                F.when(F.col("accion") == "reprogramado", F.struct("turn", "fecha_anterior", "hora_anterior"))
            ).alias("moved"),
            F.min(F.when(F.col("accion") == "insertado", F.struct("batch_id", "idx", "competencia_id", "observaciones")))
            .alias("born"),
        )
    )
    moved_note = F.format_string(
        f"Reprogramado automáticamente desde {source}. Fecha anterior: %s %s",
        F.col("moved.fecha_anterior").cast("string"),
        F.coalesce(F.substring(F.col("moved.hora_anterior"), 1, 5), F.lit("sin hora")),
    )
    changes = cut(per_pair.select(
        *PAIR,
        F.col("born"),
        *[F.col(f"last.{c}").alias(f"new_{c}") for c in last],
        F.col("round.jornada").alias("new_jornada"),
        F.when(F.col("moved").isNotNull(), moved_note).alias("moved_note"),
    ))
    known = changes.where("born is null").drop("born")
    touched = F.col("new_fecha").isNotNull()
    kept = partidos.join(known.hint("shuffle_hash"), list(PAIR), "left").withColumns(
        {
            "fecha": F.coalesce("new_fecha", "fecha"),
            "hora": F.when(touched, F.col("new_hora")).otherwise(F.col("hora")),
            "jornada": F.coalesce("new_jornada", "jornada"),
            "observaciones": F.coalesce("moved_note", "observaciones"),
            "updated_at": F.when(touched, F.to_timestamp(F.lit(run_at))).otherwise(F.col("updated_at")),
            **{c: F.coalesce(f"new_{c}", c) for c in ("programacion_url", "programacion_pdf_url", "tipo_fuente")},
        }
    )
    births = ranked(
        changes.where("born is not null"), [], [F.col("born.batch_id"), F.col("born.idx")], "position"
    )
    highest = partidos.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    default_note = F.lit(f"Importado automáticamente desde programación oficial de {source}")
    inserted = births.select(
        (highest + F.col("position")).alias("id"),
        F.col("born.competencia_id").alias("competencia_id"),
        *PAIR,
        *[F.col(f"new_{c}").alias(c) for c in (*last, "jornada")],
        F.lit("programado").alias("estado"),
        F.coalesce("moved_note", "born.observaciones", default_note).alias("observaciones"),
        F.to_timestamp(F.lit(run_at)).alias("updated_at"),
    )
    columns = [F.col(f.name).cast(f.dataType) for f in PARTIDOS if f.name in partidos.columns]
    return kept.select(*partidos.columns).unionByName(inserted, allowMissingColumns=True).select(*columns)


def review_rows(decisions: DataFrame) -> DataFrame:
    """Review entries of the rows that were not applied."""
    kind = (
        F.when(F.col("accion") == "error", REVIEW_ERROR).when(F.col("stored") > 1, REVIEW_AMBIGUOUS).otherwise(REVIEW_MOVED)
    )
    payload = F.to_json("raw")
    note = (
        F.when(F.col("tipo") == REVIEW_ERROR, "jornada inválida")
        .when(F.col("tipo") == REVIEW_AMBIGUOUS, F.format_string(AMBIGUOUS_NOTE, F.col("stored").cast("string")))
        .otherwise(MOVED_NOTE)
    )
    mark = F.when(F.col("tipo") == REVIEW_ERROR, fingerprint(F.col("tipo"), payload, note)).otherwise(
        fingerprint(F.col("tipo"), *[F.col(c) for c in (*PAIR, "fecha", "hora")])
    )
    return (
        decisions.where(F.col("accion").isin("revision", "error"))
        .withColumn("tipo", kind)
        .select(
            "batch_id", "idx", mark.alias("fingerprint"), "tipo", F.col("programacion_url").alias("fuente_url"),
            F.col("programacion_pdf_url").alias("fuente_pdf_url"), payload.alias("payload"),
            F.lit(PENDING).alias("estado"), note.alias("observaciones"),
        )
    )


def merge_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Queue keyed by fingerprint: a repeat refreshes payload and links, a repeated error changes nothing."""
    body = ("tipo", "fuente_url", "fuente_pdf_url", "payload", "estado", "observaciones")
    # a fingerprint holds its kind, so the entries that share it are all errors or none is: of errors the first counts, else the last
    sign = F.when(F.col("tipo") == REVIEW_ERROR, -1).otherwise(1)
    entry = F.struct((F.col("batch_id") * sign).alias("_batch"), (F.col("idx") * sign).alias("_idx"), *body)
    arrived = reviews.groupBy("fingerprint").agg(F.max(entry).alias("pick")).select(
        "fingerprint", F.struct(*[F.col(f"pick.{c}").alias(c) for c in body]).alias("new")
    )
    stored = queue.select("fingerprint", F.struct(*body).alias("old"))
    both = stored.join(arrived, "fingerprint", "full")
    refresh = F.col("old").isNull() | (F.col("new").isNotNull() & (F.col("new.tipo") != REVIEW_ERROR))
    refreshed = ("fuente_url", "fuente_pdf_url", "payload")
    return both.select(
        "fingerprint",
        *[
            (F.when(refresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in refreshed
             else F.coalesce(F.when(F.col("old").isNotNull(), F.col(f"old.{c}")), F.col(f"new.{c}"))).alias(c)
            for c in body
        ],
    )


def sync_matches(
    rows: DataFrame, partidos: DataFrame, queue: DataFrame, run_at: str, source: str = "la federación"
) -> SyncResult:
    """Apply accepted rows: new matches table, review queue and counters, all computed before anything is written."""
    decisions = cut(sync_decisions(rows, partidos))
    return SyncResult(
        decisions,
        sync_counters(decisions),
        apply_decisions(decisions, partidos, run_at, source),
        merge_reviews(queue, review_rows(decisions)),
    )


def import_batches(
    batches: DataFrame,
    temporadas: DataFrame,
    equipos: DataFrame,
    partidos: DataFrame,
    queue: DataFrame,
    run_at: str,
    source: str = "la federación",
    max_rows: int | None = None,
) -> tuple[DataFrame, SyncResult]:
    """Preflight, gate and sync; returns the verdicts and what the accepted batches produced."""
    verdicts, checked = preflight(batches, temporadas, equipos, max_rows)
    # read by the gate, which feeds two branches, and by the caller's log
    verdicts = cut(verdicts)
    return verdicts, sync_matches(gate(checked, verdicts), partidos, queue, run_at, source)
