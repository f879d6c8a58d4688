"""Integrity checks: each one returns its offenders, the report counts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions.text import is_blank, normalize_key

# Accepted kinds of fixture publication and declared final states.
SOURCE_TYPES = ("fecha_normal", "reprogramacion")
FINAL_STATES = ("finalizado", "final")
TEAM_IDENTITY = ("club_id", "temporada_id", "categoria", "division", "rama", "equipo_codigo")
MATCH_IDENTITY = ("temporada_id", "fecha", "hora", "local_equipo_id", "visitante_equipo_id")


def _season(df: DataFrame, season_id: int | None) -> DataFrame:
    return df if season_id is None else df.where(F.col("temporada_id") == season_id)


def _groups(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def broken_refs(partidos: DataFrame, equipos: DataFrame) -> DataFrame:
    """Ids of matches without one or both of their teams, each match once."""
    lost = [
        partidos.join(equipos.select(F.col("id").alias(side)), side, "left_anti").select("id")
        for side in ("local_equipo_id", "visitante_equipo_id")
    ]
    return lost[0].unionByName(lost[1]).distinct()


def importable(partidos: DataFrame, equipos: DataFrame, temporadas: DataFrame) -> DataFrame:
    """Matches whose season exists and whose teams both exist and are active."""
    active = equipos.where("activo").select("id")
    kept = partidos.join(temporadas.select(F.col("id").alias("temporada_id")), "temporada_id", "left_semi")
    for side in ("local_equipo_id", "visitante_equipo_id"):
        kept = kept.join(active.withColumnRenamed("id", side), side, "left_semi")
    return kept


def of_another_season(facts: DataFrame) -> DataFrame:
    """Matches of two known teams, one of which is registered for another season than the match; a missing season differs from any."""
    differs = [~F.col(f"{side}_scope.temporada_id").eqNullSafe(F.col("temporada_id")) for side in ("home", "away")]
    return facts.where(F.col("home_id").isNotNull() & F.col("away_id").isNotNull() & (differs[0] | differs[1]))


def duplicate_clubs(clubes: DataFrame) -> DataFrame:
    return _groups(clubes, normalize_key(F.col("nombre")).alias("club_key"))


def duplicate_teams(equipos: DataFrame, season_id: int | None = None) -> DataFrame:
    return _groups(_season(equipos, season_id), *TEAM_IDENTITY)


def duplicate_matches(partidos: DataFrame, season_id: int | None = None) -> DataFrame:
    return _groups(_season(partidos, season_id), *MATCH_IDENTITY)


def match_facts(
    partidos: DataFrame, equipos: DataFrame, temporadas: DataFrame, season_id: int | None = None
) -> DataFrame:
    """Matches beside the scope of both teams and the competition of their season."""

    def side(prefix: str) -> DataFrame:
        return equipos.select(
            F.col("id").alias(f"{prefix}_id"),
            F.struct("temporada_id", "categoria", "division", "rama").alias(f"{prefix}_scope"),
        )

    seasons = temporadas.select(F.col("id").alias("season"), F.col("competencia_id").alias("season_competition"))
    return (
        _season(partidos, season_id)
        .join(side("home"), F.col("local_equipo_id") == F.col("home_id"), "left")
        .join(side("away"), F.col("visitante_equipo_id") == F.col("away_id"), "left")
        .join(seasons, F.col("temporada_id") == F.col("season"), "left")
    )


def match_checks() -> dict[str, Column]:
    """Predicate of each match check over ``match_facts``."""

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    has_home, has_away = F.col("goles_local").isNotNull(), F.col("goles_visitante").isNotNull()
    both_known = F.col("home_id").isNotNull() & F.col("away_id").isNotNull()
    other_scope = (
        differs("home_scope.temporada_id", "temporada_id")
        | differs("away_scope.temporada_id", "temporada_id")
        | differs("home_scope.categoria", "away_scope.categoria")
        | differs("home_scope.division", "away_scope.division")
        | differs("home_scope.rama", "away_scope.rama")
    )
    untraced = is_blank(F.col("programacion_url")) | is_blank(F.col("programacion_pdf_url")) | is_blank(
        F.col("tipo_fuente")
    )
    return {
        "invalid_match_refs": ~both_known,
        "cross_scope_matches": both_known & other_scope,
        "same_team_matches": F.col("local_equipo_id") == F.col("visitante_equipo_id"),
        "matches_missing_source_trace": untraced,
        "competition_season_mismatches": F.col("season").isNotNull() & differs("competencia_id", "season_competition"),
        "partial_score_matches": has_home != has_away,
        "programmed_matches_with_score": (F.col("estado") == "programado") & (has_home | has_away),
        "finished_matches_without_score": F.col("estado").isin(*FINAL_STATES) & ~(has_home & has_away),
        "unknown_source_type_matches": ~F.col("tipo_fuente").isin(*SOURCE_TYPES),
    }


def offenders(facts: DataFrame, check: str) -> DataFrame:
    """Matches that fail a check."""
    return facts.where(match_checks()[check])


# Counters that, like every match check, must be zero for a clean base.
ZERO_COUNTERS = ("duplicate_club_groups", "duplicate_team_groups", "exact_duplicate_match_groups")


def integrity_report(
    clubes: DataFrame,
    equipos: DataFrame,
    partidos: DataFrame,
    temporadas: DataFrame,
    club_aliases: DataFrame,
    season_id: int | None = None,
) -> DataFrame:
    """One row with every counter and the verdict."""
    checks = match_checks()
    facts = match_facts(partidos, equipos, temporadas, season_id)
    frames = [
        duplicate_clubs(clubes).agg(F.count("*").alias("duplicate_club_groups")),
        duplicate_teams(equipos, season_id).agg(F.count("*").alias("duplicate_team_groups")),
        duplicate_matches(partidos, season_id).agg(F.count("*").alias("exact_duplicate_match_groups")),
        clubes.agg(F.count_if("activo").alias("active_clubs")),
        club_aliases.where("activo").agg(
            F.countDistinct("club_id").alias("clubs_with_active_alias"), F.count("*").alias("active_aliases")
        ),
        facts.agg(F.count("*").alias("matches"), *[F.count_if(bad).alias(name) for name, bad in checks.items()]),
    ]
    report = _one_row(frames)
    clean = F.col("clubs_with_active_alias") == F.col("active_clubs")
    for name in (*ZERO_COUNTERS, *checks):
        clean = clean & (F.col(name) == 0)
    return report.withColumns({"temporada_id": F.lit(season_id).cast("bigint"), "ok": clean})


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Put one-row frames side by side without joining them."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).cast("bigint").alias(c) for c in merged.columns])


def integrity_script(clubes: DataFrame, equipos: DataFrame, partidos: DataFrame, temporadas: DataFrame) -> DataFrame:
    """First six counters over every season."""
    checks = match_checks()
    facts = match_facts(partidos, equipos, temporadas)
    return _one_row(
        [
            duplicate_clubs(clubes).agg(F.count("*").alias("duplicate_club_groups")),
            duplicate_teams(equipos).agg(F.count("*").alias("duplicate_team_groups")),
            duplicate_matches(partidos).agg(F.count("*").alias("exact_duplicate_match_groups")),
            facts.agg(
                *[F.count_if(checks[c]).alias(c) for c in
                  ("invalid_match_refs", "cross_scope_matches", "same_team_matches")]
            ),
        ]
    )


def alias_coverage(club_aliases: DataFrame) -> DataFrame:
    return club_aliases.agg(
        F.count("*").alias("total_aliases"),
        F.count_if("activo").alias("active_aliases"),
        F.countDistinct(F.when(F.col("activo"), F.col("club_id"))).alias("clubs_with_active_alias"),
    )


def season_counts(temporadas: DataFrame, equipos: DataFrame, partidos: DataFrame) -> DataFrame:
    """Teams, matches and dates of each season; each side is counted before the join, so nothing fans out."""
    teams = equipos.groupBy("temporada_id").agg(F.countDistinct("id").alias("equipos"))
    matches = partidos.groupBy("temporada_id").agg(
        F.countDistinct("id").alias("partidos"),
        F.min("fecha").alias("primera_fecha"),
        F.max("fecha").alias("ultima_fecha"),
    )
    return (
        temporadas.select(F.col("id").alias("temporada_id"), "nombre")
        .join(teams, "temporada_id", "left")
        .join(matches, "temporada_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("equipos", "partidos")})
    )


def scope_overlap_pairs(matches: DataFrame) -> DataFrame:
    """Club pairs that meet in more than one competition and in how many."""
    low = F.least("home_club_id", "away_club_id").alias("club_a")
    high = F.greatest("home_club_id", "away_club_id").alias("club_b")
    met = matches.where(F.col("home_scope") == F.col("away_scope"))
    return met.groupBy(low, high).agg(F.countDistinct("home_scope").alias("scopes")).where("scopes > 1")


def match_scope_violations(partidos: DataFrame, equipos: DataFrame, temporadas: DataFrame) -> DataFrame:
    """First rule each match breaks before it may be stored; matches that break none are absent."""
    facts = match_facts(partidos, equipos, temporadas)

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("null"))

    home, away = F.col("local_equipo_id"), F.col("visitante_equipo_id")
    mismatch = F.format_string(
        "competencia_id (%s) no corresponde a temporada %s (competencia esperada %s)",
        text("competencia_id"), text("temporada_id"), text("season_competition"),
    )
    out_of_season = ~F.col("home_scope.temporada_id").eqNullSafe(F.col("temporada_id")) | ~F.col(
        "away_scope.temporada_id"
    ).eqNullSafe(F.col("temporada_id"))
    rules = [
        (F.col("temporada_id").isNull(), F.lit("temporada_id requerido para validar el partido")),
        (F.col("season_competition").isNull(), F.concat(F.lit("Temporada inexistente: "), text("temporada_id"))),
        (~F.col("competencia_id").eqNullSafe(F.col("season_competition")), mismatch),
        (home.isNull() | away.isNull(), F.lit("local_equipo_id y visitante_equipo_id son requeridos")),
        (home == away, F.lit("Local y visitante no pueden ser el mismo equipo")),
        (F.col("home_id").isNull(), F.concat(F.lit("Equipo local inexistente: "), text("local_equipo_id"))),
        (F.col("away_id").isNull(), F.concat(F.lit("Equipo visitante inexistente: "), text("visitante_equipo_id"))),
        (out_of_season, F.concat(F.lit("Los equipos deben pertenecer a la temporada del partido ("),
                                 text("temporada_id"), F.lit(")"))),
        (match_checks()["cross_scope_matches"], F.lit("Local y visitante deben pertenecer al mismo scope competitivo")),
    ]
    error = F.coalesce(*[F.when(bad, message) for bad, message in rules])
    return facts.select(F.col("id").alias("match_id"), error.alias("error")).where("error is not null")
