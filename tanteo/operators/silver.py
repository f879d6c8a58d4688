"""Raw league tables to typed, checked ones: every row with a bad reference is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tanteo.functions import labels
from tanteo.functions.dates import hhmm
from tanteo.functions.numbers import to_id, to_number
from tanteo.functions.text import initials, null_if_empty
from tanteo.schemas import ALIASES, SCOPE


def field(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """First non-null, non-empty value among the columns present, as ``kind``."""
    present = [F.col(n) if _is_whole(df, n) else null_if_empty(F.col(n)) for n in names if n in df.columns]
    return (F.coalesce(*present) if present else F.lit(None)).cast(kind)


def numeric_field(df: DataFrame, names: Sequence[str]) -> Column:
    """``field`` as a finite number, null otherwise."""
    present = [n for n in names if n in df.columns]
    if present and all(_is_whole(df, n) for n in present):
        return F.coalesce(*map(F.col, present)).cast("double")
    return to_number(field(df, names), None)


def _is_whole(df: DataFrame, name: str) -> bool:
    """Whether a column holds whole numbers by its type: such a value needs no reading as text, which costs more than the joins."""
    return isinstance(df.schema[name].dataType, IntegralType)


def id_field(df: DataFrame, names: Sequence[str]) -> Column:
    """Numeric id from the first non-empty value among the columns present."""
    present = [n for n in names if n in df.columns]
    if present and all(_is_whole(df, n) for n in present):
        return F.coalesce(*map(F.col, present)).cast("bigint")
    # A single name is a column that must be there.
    return to_id(F.col(names[0]) if len(names) == 1 else field(df, names))


def _alias(df: DataFrame, name: str, kind: str = "string") -> Column:
    return field(df, ALIASES.get(name, (name,)), kind)


def _flag(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("boolean") if name in df.columns else F.lit(None).cast("boolean")


def _count(df: DataFrame, name: str) -> Column:
    """Whole number, zero when missing."""
    return F.coalesce(numeric_field(df, ALIASES.get(name, (name,))), F.lit(0)).cast("bigint")


def _optional_count(df: DataFrame, name: str) -> Column:
    return numeric_field(df, ALIASES.get(name, (name,))).cast("bigint")


def normalize_clubs(raw: DataFrame) -> DataFrame:
    name = field(raw, ["nombre"])
    return raw.select(
        id_field(raw, ["id"]).alias("club_id"),
        F.coalesce(name, F.lit("Club")).alias("club_name"),
        F.coalesce(field(raw, ["abreviatura"]), initials(name)).alias("abbr"),
        F.coalesce(field(raw, ["ciudad"]), F.lit("")).alias("city"),
        field(raw, ["logo_url"]).alias("logo_url"),
        _flag(raw, "activo").alias("active"),
    ).where(F.col("club_id").isNotNull())


def normalize_teams(raw: DataFrame, clubs: DataFrame, season_id: int | None) -> DataFrame:
    """Teams of the season whose club survived; every season when ``season_id`` is None."""
    teams = raw.select(
        id_field(raw, ["id"]).alias("team_id"),
        id_field(raw, ["club_id"]).alias("club_id"),
        id_field(raw, ["temporada_id"]).alias("season_id"),
        F.col("categoria").alias("category"),
        F.col("division"),
        F.col("rama").alias("branch"),
        labels.team_code(field(raw, ["equipo_codigo"])).alias("team_code"),
        field(raw, ["nombre_federacion"]).alias("federation_name"),
        _flag(raw, "activo").alias("active"),
    ).where(F.col("team_id").isNotNull() & F.col("season_id").isNotNull())
    if season_id is not None:
        teams = teams.where(F.col("season_id") == season_id)
    return teams.join(clubs.select("club_id"), "club_id", "left_semi")


def normalize_players(raw: DataFrame) -> DataFrame:
    first, last = (F.coalesce(field(raw, [c]), F.lit("")) for c in ("nombre", "apellido"))
    full = F.trim(F.concat(first, F.lit(" "), last))
    return raw.select(
        id_field(raw, ["id"]).alias("player_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.coalesce(null_if_empty(full), F.lit("Jugador")).alias("player_name"),
        field(raw, ["fecha_nacimiento"]).alias("birth_date"),
        field(raw, ["brazo_habil"]).alias("dominant_arm"),
        numeric_field(raw, ["altura_cm"]).alias("height_cm"),
        numeric_field(raw, ["peso_kg"]).alias("weight_kg"),
    ).where(F.col("player_id").isNotNull())


def normalize_rosters(raw: DataFrame, players: DataFrame, teams: DataFrame, team_columns: Sequence[str] = ()) -> DataFrame:
    """Roster rows of known players and teams, with these columns of their team."""
    rosters = raw.select(
        id_field(raw, ["id"]).alias("roster_id"),
        id_field(raw, ["jugador_id"]).alias("player_id"),
        id_field(raw, ["equipo_id"]).alias("team_id"),
        field(raw, ["dorsal"]).try_cast("int").alias("shirt"),
        F.coalesce(field(raw, ["posicion"]), F.lit(labels.NO_POSITION)).alias("position"),
    )
    of_teams = rosters.join(teams.select("team_id", *team_columns), "team_id", "inner" if team_columns else "left_semi")
    return of_teams.join(players.select("player_id"), "player_id", "left_semi")


def team_cards(teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """Teams with their club's columns and display name."""
    joined = teams.join(clubs.drop("active"), "club_id", "left")
    name = labels.team_name(F.col("club_name"), F.col("federation_name"), F.col("team_code"))
    return joined.withColumn("team_name", name)


def normalize_matches(raw: DataFrame, teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """Matches whose two teams survived, with names, scopes, status and scores of finished ones."""
    return match_team_club(typed_matches(raw), team_cards(teams, clubs))


def typed_matches(raw: DataFrame, *carried: Column) -> DataFrame:
    finished = labels.is_finished(_alias(raw, "estado"), _alias(raw, "goles_local"), _alias(raw, "goles_visitante"))
    jornada = _alias(raw, "jornada")
    return raw.select(
        id_field(raw, ["id"]).alias("match_id"),
        F.coalesce(_alias(raw, "fecha"), F.lit("")).alias("match_date"),
        hhmm(_alias(raw, "hora")).alias("match_time"),
        jornada.alias("round"),
        F.when(jornada.isNotNull(), F.concat(F.lit("Fecha "), jornada)).otherwise("Partido").alias("round_label"),
        id_field(raw, ALIASES["local_equipo_id"]).alias("home_team_id"),
        id_field(raw, ALIASES["visitante_equipo_id"]).alias("away_team_id"),
        F.when(finished, _optional_count(raw, "goles_local")).alias("home_score"),
        F.when(finished, _optional_count(raw, "goles_visitante")).alias("away_score"),
        F.when(finished, labels.FINISHED).otherwise(labels.SCHEDULED).alias("status"),
        F.coalesce(_alias(raw, "observaciones"), F.lit("")).alias("notes"),
        _alias(raw, "planilla_url").alias("sheet_url"),
        _alias(raw, "video_url").alias("video_url"),
        field(raw, ["programacion_pdf_url", "programacion_url"]).alias("fixture_url"),
        *carried,
    )


def scope_key() -> Column:
    """One text per competition of a team: no two of them share it, whatever their names hold, and null is not an empty name."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in SCOPE]))


def match_team_club(matches: DataFrame, cards: DataFrame, *columns: str) -> DataFrame:
    """Join each match to the card of its home and away team, with these columns of both; both must exist."""
    def side(prefix: str) -> DataFrame:
        return cards.select(
            F.col("team_id").alias(f"{prefix}_team_id"),
            F.col("club_id").alias(f"{prefix}_club_id"),
            F.col("team_code").alias(f"{prefix}_code"),
            F.col("team_name").alias(f"{prefix}_name"),
            scope_key().alias(f"{prefix}_scope"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
        )

    return matches.join(side("home"), "home_team_id").join(side("away"), "away_team_id")


def typed_participations(raw: DataFrame) -> DataFrame:
    return raw.select(
        id_field(raw, ["id"]).alias("line_id"),
        id_field(raw, ["partido_id"]).alias("match_id"),
        id_field(raw, ["jugador_id"]).alias("player_id"),
        id_field(raw, ["equipo_id"]).alias("team_id"),
        _count(raw, "goles").alias("goals"),
        _count(raw, "exclusiones_2min").alias("two_min"),
        _count(raw, "tarjeta_amarilla").alias("yellow"),
        _count(raw, "tarjeta_roja").alias("red"),
        _optional_count(raw, "asistencias").alias("assists"),
        _optional_count(raw, "lanzamientos").alias("shots"),
        _optional_count(raw, "atajadas").alias("saves"),
        _optional_count(raw, "dorsal_utilizado").cast("int").alias("shirt_used"),
    )


def normalize_participations(
    raw: DataFrame, players: DataFrame, teams: DataFrame, matches: DataFrame
) -> DataFrame:
    """Lines of known players whose team is one of the two of a known match."""
    # The sides are fewer and narrower than the lines: the teams are looked up there.
    sides = match_sides(matches).join(teams.select("team_id"), "team_id", "left_semi")
    in_match = typed_participations(raw).join(sides, ["match_id", "team_id"], "left_semi")
    return in_match.join(players.select("player_id"), "player_id", "left_semi")


def match_sides(matches: DataFrame) -> DataFrame:
    """Each match beside each of its different teams."""
    teams = F.explode(F.array_distinct(F.array("home_team_id", "away_team_id")))
    return matches.select("match_id", teams.alias("team_id"))


def participations_in_matches(participations: DataFrame, matches: DataFrame) -> DataFrame:
    """Lines whose match is kept and whose team plays it."""
    # One semi join on (match, team): a hot match is then split over its two teams.
    return participations.join(match_sides(matches), ["match_id", "team_id"], "left_semi")
