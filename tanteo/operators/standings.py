"""League tables: results per team, head-to-head, final order, point adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions import labels
from tanteo.functions.numbers import goal_quotient, result_letter, result_points
from tanteo.functions.text import spanish, strip_edges
from tanteo.operators.ranking import ranked, top_per_group
from tanteo.schemas import SCOPE
from tanteo.session import cut

FORM_LENGTH = 5


def standings_view(raw_teams: DataFrame, raw_clubs: DataFrame, raw_matches: DataFrame) -> DataFrame:
    """Table of every active team over all matches with two scores, whatever their state."""
    scored = raw_matches.where(F.col("goles_local").isNotNull() & F.col("goles_visitante").isNotNull())
    home, away = F.col("goles_local"), F.col("goles_visitante")
    played = scored.select(
        "temporada_id",
        F.inline(
            F.array(
                F.struct(F.col("local_equipo_id").alias("equipo_id"), home.alias("own"), away.alias("opp")),
                F.struct(F.col("visitante_equipo_id").alias("equipo_id"), away.alias("own"), home.alias("opp")),
            )
        ),
    )
    totals = played.groupBy("temporada_id", "equipo_id").agg(
        F.count("*").alias("pj"),
        F.count_if(F.col("own") > F.col("opp")).alias("pg"),
        F.count_if(F.col("own") == F.col("opp")).alias("pe"),
        F.count_if(F.col("own") < F.col("opp")).alias("pp"),
        F.sum("own").alias("gf"),
        F.sum("opp").alias("ga"),
    )
    teams = raw_teams.where("activo").select(
        "temporada_id", F.col("id").alias("equipo_id"), "club_id", "rama", "categoria", "division", "equipo_codigo"
    )
    clubs = raw_clubs.select(F.col("id").alias("club_id"), F.col("nombre").alias("club"))
    table = teams.join(clubs, "club_id").join(totals, ["temporada_id", "equipo_id"], "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("pj", "pg", "pe", "pp", "gf", "ga")}
    return table.select(
        "temporada_id", "equipo_id", "club_id", "club", "rama", "categoria", "division", "equipo_codigo",
        *[value.alias(c) for c, value in counts.items()],
        (counts["gf"] - counts["ga"]).alias("dif"),
        (counts["pg"] * 3 + counts["pe"] * 2 + counts["pp"]).alias("puntos"),
    )


def match_sides(matches: DataFrame, *carried: str) -> DataFrame:
    """Each match as two rows, one per team, from a single scan."""

    def side(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.col(f"{own}_score").alias("own"),
            F.col(f"{other}_score").alias("opp"),
            F.lit(own == "home").alias("at_home"),
        )

    return matches.select(*carried, F.inline(F.array(side("home", "away"), side("away", "home"))))


def finished_matches(matches: DataFrame) -> DataFrame:
    """Finished matches with both scores: a missing score is never read as zero."""
    return matches.where(
        (F.col("status") == labels.FINISHED) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    )


def team_results(matches: DataFrame) -> DataFrame:
    """Wins, draws, defeats, goals and points per team."""
    own, opp = F.col("own"), F.col("opp")
    return (
        match_sides(finished_matches(matches))
        .groupBy("team_id")
        .agg(
            F.count("*").alias("played"),
            F.count_if(own > opp).alias("won"),
            F.count_if(own == opp).alias("drawn"),
            F.count_if(own < opp).alias("lost"),
            F.sum(own).alias("gf"),
            F.sum(opp).alias("ga"),
            F.sum(result_points(own, opp)).alias("points"),
        )
    )


RESULT_COLUMNS = ("played", "won", "drawn", "lost", "gf", "ga", "gd", "points")


def result_table(cards: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per team with its results, zeros when it has none; ``matches`` are already those in scope."""
    joined = cards.join(team_results(matches), "team_id", "left")
    return (
        joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in RESULT_COLUMNS if c != "gd"})
        .withColumn("gd", F.col("gf") - F.col("ga"))
        .withColumn("name", F.col("team_name"))
    )


def team_table(
    cards: DataFrame, matches: DataFrame, rosters: DataFrame, player_stats: DataFrame
) -> DataFrame:
    """``result_table`` with roster size, goals of the rostered players and recent form."""
    goals = player_stats.select("player_id", "team_id", "goals")
    squads = (
        rosters.select("player_id", "team_id")
        .join(goals, ["player_id", "team_id"], "left")
        .groupBy("team_id")
        .agg(F.count("*").alias("players"), F.coalesce(F.sum("goals"), F.lit(0)).alias("goals"))
    )
    table = result_table(cards, matches).join(squads, "team_id", "left").join(team_form(matches), "team_id", "left")
    return table.withColumns(
        {
            "players": F.coalesce(F.col("players"), F.lit(0)).cast("bigint"),
            "goals": F.coalesce(F.col("goals"), F.lit(0)).cast("bigint"),
            "form": F.coalesce(F.col("form"), F.array().cast("array<string>")),
        }
    )


def team_form(matches: DataFrame, length: int = FORM_LENGTH) -> DataFrame:
    """Letters of the last results of each team, oldest first."""
    sides = match_sides(finished_matches(matches), "match_id", "match_date", "match_time")
    newest = [F.desc("match_date"), F.desc("match_time"), F.desc("match_id"), F.desc("at_home")]
    last = top_per_group(sides, ["team_id"], newest, length, "recency")
    # At most ``length`` rows per team are collected.
    letters = F.sort_array(
        F.collect_list(F.struct((-F.col("recency")).alias("age"), result_letter(F.col("own"), F.col("opp")).alias("r")))
    )
    return last.groupBy("team_id").agg(F.transform(letters, lambda x: x["r"]).alias("form"))


def head_to_head_matches(table: DataFrame, matches: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Finished matches between two teams level on points in the same table."""
    probe = table.select("team_id", F.struct(*by, "points").alias("level"))
    home = probe.select(F.col("team_id").alias("home_team_id"), F.col("level").alias("home_level"))
    away = probe.select(F.col("team_id").alias("away_team_id"), F.col("level").alias("away_level"))
    games = finished_matches(matches).select("match_id", "home_team_id", "away_team_id", "home_score", "away_score")
    # Joined by team, which is selective, and only then compared on the few-valued points.
    return (
        games.join(home, "home_team_id")
        .join(away, "away_team_id")
        .where(F.col("home_level") == F.col("away_level"))
        .drop("home_level", "away_level")
    )


def mini_table(table: DataFrame, matches: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Points and goals of each team in its matches against the teams it is level with."""
    own, opp = F.col("own"), F.col("opp")
    return (
        match_sides(head_to_head_matches(table, matches, by))
        .groupBy("team_id")
        .agg(
            F.count("*").alias("mini_played"),
            F.sum(result_points(own, opp)).alias("mini_points"),
            F.sum(own).alias("mini_gf"),
            F.sum(opp).alias("mini_ga"),
        )
    )


def standings(table: DataFrame, matches: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Final order: points, then the mini-table among level teams, then overall criteria.

    A team without head-to-head matches counts zero in the mini-table, so groups that never met fall through to the
    overall criteria in the same sort.
    """
    table = cut(table)
    mini = mini_table(table, matches, by)
    mini_columns = ("mini_played", "mini_points", "mini_gf", "mini_ga")
    full = table.join(mini, "team_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in mini_columns}
    )
    return ranked(full, by, standings_order())


def standings_order() -> list[Column]:
    gd, mini_gd = F.col("gf") - F.col("ga"), F.col("mini_gf") - F.col("mini_ga")
    return [
        F.desc("points"),
        F.desc("mini_points"),
        mini_gd.desc(),
        F.desc("mini_gf"),
        F.asc("mini_ga"),
        gd.desc(),
        F.desc("gf"),
        F.asc("ga"),
        goal_quotient(F.col("gf"), F.col("ga")).desc(),
        spanish(F.col("name")).asc(),
        F.asc("team_id"),
    ]


def validate_adjustments(
    adjustments: DataFrame,
    season_id: int | None = None,
    competition_id: int | None = None,
    teams: DataFrame | None = None,
) -> DataFrame:
    """Adjustments with every reason they fail; an empty list means valid."""

    def whole(column: str) -> Column:
        return F.trim(F.col(column).cast("string")).try_cast("bigint")

    def missing(column: str) -> Column:
        return F.coalesce(strip_edges(F.col(column).cast("string")), F.lit("")) == ""

    checked = adjustments.withColumn("_team", whole("team_id"))
    if teams is not None:
        known = teams.select(F.col("team_id").alias("_known")).distinct()
        checked = checked.join(known, F.col("_team") == F.col("_known"), "left")
    delta = whole("points_delta")
    rules = [
        (F.col("_team").isNull(), "teamId requerido"),
        (whole("season_id").isNull(), "seasonId requerido"),
        (whole("competition_id").isNull(), "competitionId requerido"),
        (delta.isNull() | (delta == 0), "pointsDelta entero no cero requerido"),
        (missing("reason"), "reason requerido"),
        (missing("official_source"), "officialSource requerida"),
        (missing("resolution_date"), "resolutionDate requerida"),
    ]
    if season_id is not None:
        rules.append((~whole("season_id").eqNullSafe(F.lit(season_id)), "seasonId fuera de scope"))
    if competition_id is not None:
        rules.append((~whole("competition_id").eqNullSafe(F.lit(competition_id)), "competitionId fuera de scope"))
    if teams is not None:
        rules.append((F.col("_known").isNull(), "teamId fuera de scope"))
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    return checked.withColumn("errors", errors).drop("_known", "_team")


def apply_adjustments(
    table: DataFrame, adjustments: DataFrame, season_id: int | None = None, competition_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Table with sporting and administrative points apart, and the adjustments left out with their reasons.

    The order is not re-applied: rank the result again with ``standings``.
    """
    team = F.trim(F.col("team_id").cast("string")).try_cast("bigint")
    checked = validate_adjustments(adjustments, season_id, competition_id, table.select("team_id"))
    valid = F.size("errors") == 0
    totals = (
        checked.where(valid)
        .groupBy(team.alias("team_id"))
        .agg(
            F.sum(F.col("points_delta").cast("bigint")).alias("administrative_points"),
            F.count("*").alias("applied_adjustments"),
        )
    )
    rows = (
        table.withColumnRenamed("points", "sporting_points")
        .join(totals, "team_id", "left")
        .withColumns(
            {
                "administrative_points": F.coalesce(F.col("administrative_points"), F.lit(0)).cast("bigint"),
                "applied_adjustments": F.coalesce(F.col("applied_adjustments"), F.lit(0)).cast("bigint"),
            }
        )
        .withColumn("points", F.col("sporting_points") + F.col("administrative_points"))
    )
    ids = table.select(F.col("team_id").alias("_row")).distinct()
    rejected = (
        checked.where(~valid)
        .join(ids, team == F.col("_row"), "left")
        .withColumn(
            "errors",
            F.when(F.col("_row").isNull(), F.array_append("errors", F.lit("teamId sin fila en tabla"))).otherwise(
                F.col("errors")
            ),
        )
        .drop("_row")
    )
    return rows, rejected
