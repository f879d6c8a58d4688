"""Player statistics, leaderboards and match logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanteo.functions import labels
from tanteo.functions.numbers import ratio_1dp
from tanteo.functions.text import normalize_text, spanish
from tanteo.operators.ranking import ranked, top_overall, top_per_group

STAT_COLUMNS = ("matches_played", "goals", "two_min", "yellow", "red", "sanctions")
NO_SHIRT_RANK = 999


def player_team_stats(participations: DataFrame) -> DataFrame:
    """Totals of each (player, team); metrics never recorded stay null."""
    totals = participations.groupBy("player_id", "team_id").agg(
        F.countDistinct("match_id").alias("matches_played"),
        *[F.sum(c).alias(c) for c in ("goals", "two_min", "yellow", "red", "assists", "shots", "saves")],
    )
    return _with_rates(totals)


def _with_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "sanctions": F.col("two_min") + F.col("yellow") + F.col("red"),
            "goals_per_match": ratio_1dp(F.col("goals"), F.col("matches_played")),
            "efficiency": ratio_1dp(F.col("goals") * 100, F.col("shots")),
        }
    )


def player_sheet(rosters: DataFrame, players: DataFrame, cards: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per roster membership with the player, the team, the club and the statistics for that team only."""
    people = roster_player_team_club(rosters, players, cards)
    joined = people.join(stats, ["player_id", "team_id"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in STAT_COLUMNS})


def roster_player_team_club(rosters: DataFrame, players: DataFrame, cards: DataFrame) -> DataFrame:
    """Roster membership with its player, team and club."""
    team = cards.select(
        "team_id", "club_id", "team_code", "branch", "category", "division", F.col("team_name").alias("club"),
        F.coalesce(F.col("club_name"), F.lit("Sin club")).alias("club_name"), "season_id",
    )
    return rosters.join(players, "player_id").join(team, "team_id")


def search_players(
    sheet: DataFrame, term: str = "", club_id: int | None = None, position: str = "", sort: str = "goals"
) -> DataFrame:
    """Players whose name or club contains the term, with optional club and position, in the chosen order."""
    if term:
        name = F.concat_ws(" ", "player_name", "club")
        sheet = sheet.where(normalize_text(name).contains(normalize_text(F.lit(term))))
    if club_id is not None:
        sheet = sheet.where(F.col("club_id") == club_id)
    if position:
        sheet = sheet.where(F.col("position") == position)
    return sheet.orderBy(*player_order(sort))


def player_order(sort: str) -> list[Column]:
    keys = {
        "goals": [F.desc("goals"), F.desc("matches_played")],
        "matches": [F.desc("matches_played"), F.desc("goals")],
        "name": [spanish(F.col("player_name"))],
    }
    return [*keys[sort], *_identity()]


def _identity() -> list[Column]:
    return [F.asc("player_id"), F.asc("team_id"), F.asc("roster_id")]


def participation_list(sheet: DataFrame, term: str = "") -> DataFrame:
    """Every player line, best scorers first, with its position."""
    found = search_players(sheet, term).select(
        "roster_id", "player_id", "player_name", "team_id", "club", "matches_played", "goals", "goals_per_match",
        "two_min", "yellow", "red",
    )
    return ranked(found, [], player_order("goals"))


# Order of each leaderboard; ties end in the ids.
LEADERBOARDS = {
    "goals": ("goals",),
    "rate": ("goals_per_match", "goals"),
    "played": ("matches_played", "goals"),
    "sanctions": ("sanctions", "two_min"),
}


def leaderboard(sheet: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """First ``k`` players by goals, rate, matches or sanctions."""
    if kind == "rate":
        sheet = sheet.where(F.col("matches_played") > 0)
    order = [F.desc(c) for c in LEADERBOARDS[kind]] + _identity()
    return top_overall(sheet, order, k)


# Caption and unit of each highlight card.
HIGHLIGHTS = (
    ("goals", "GOLEADOR LIGA DE HONOR", "goals", "goles"),
    ("rate", "GOLES / PARTIDO", "goals_per_match", "promedio"),
    ("played", "MÁS PARTIDOS", "matches_played", "partidos"),
    ("sanctions", "SANCIONES", "sanctions", "totales"),
)


def highlights(sheet: DataFrame) -> DataFrame:
    """Leader of each board in one pass; the rate card falls back to the top scorer when nobody played."""

    def best(first: str, eligible: Column) -> Column:
        # Ascending struct of negated measures: the smallest is the leader, ids break ties.
        key = F.struct(
            (-F.coalesce(F.col(first), F.lit(0)).cast("double")).alias("measure"),
            "player_id", "team_id", "roster_id", "player_name", "club",
        )
        return F.min(F.when(eligible, key))

    everyone, played = F.lit(True), F.col("matches_played") > 0
    leaders = sheet.agg(
        *[best(measure, played if kind == "rate" else everyone).alias(kind) for kind, _, measure, _ in HIGHLIGHTS]
    ).withColumn("rate", F.coalesce("rate", F.col("goals").withField("measure", F.lit(0.0))))
    cards = F.array(
        *[
            F.struct(F.lit(caption).alias("card"), F.col(kind).alias("leader"), F.lit(unit).alias("unit"))
            for kind, caption, _, unit in HIGHLIGHTS
        ]
    )
    return (
        leaders.select(F.inline(cards))
        .where(F.col("leader").isNotNull())
        .select(
            "card", "leader.player_id", "leader.team_id", "leader.player_name", "leader.club",
            (F.lit(0.0) - F.col("leader.measure")).alias("value"), "unit",
        )
    )


def club_scorers(sheet: DataFrame, k: int = 5) -> DataFrame:
    """Best scorers of every club: goals, then name."""
    order = [F.desc("goals"), spanish(F.col("player_name")).asc(), *_identity()]
    return top_per_group(sheet, ["club_id"], order, k)


def participation_roster(participations: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Lines with the player's name and the shirt and position of the same team's roster."""
    first = rosters.groupBy("player_id", "team_id").agg(
        F.min(F.struct("roster_id", "shirt", "position")).alias("_roster")
    )
    joined = participations.join(players.select("player_id", "player_name"), "player_id", "left").join(
        first, ["player_id", "team_id"], "left"
    )
    return joined.select(
        "line_id", "match_id", "player_id", "team_id",
        F.coalesce("player_name", F.lit("Jugador")).alias("player_name"),
        F.coalesce("shirt_used", F.col("_roster.shirt")).alias("number"),
        F.coalesce(F.col("_roster.position"), F.lit("—")).alias("position"),
        "goals", "two_min", "yellow", "red",
    )


def lineup_order() -> list[Column]:
    """Order of the lines of a match: goals, then shirt number, missing numbers last."""
    return [
        F.desc("goals"), F.coalesce(F.col("number"), F.lit(NO_SHIRT_RANK)).asc(), F.asc("player_id"), F.asc("line_id"),
        F.asc("two_min"), F.asc("yellow"), F.asc("red"),
    ]


def match_lineups(lines: DataFrame) -> DataFrame:
    """Position of each line inside its match and team."""
    return ranked(lines, ["match_id", "team_id"], lineup_order())


def match_side_totals(participations: DataFrame) -> DataFrame:
    """Goals on the sheet per team and match."""
    return participations.groupBy("match_id", "team_id").agg(
        F.count("*").alias("lines"), F.sum("goals").alias("goals")
    )


def player_match_log(participations: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per player, team and match: the first line wins."""
    first = participations.groupBy("player_id", "team_id", "match_id").agg(
        F.min(F.struct("line_id", "goals", "two_min", "yellow", "red")).alias("_line")
    )
    games = matches.select(
        "match_id", "match_date", "match_time", "home_name", "away_name", "home_score", "away_score", "status"
    )
    return first.join(games, "match_id").select(
        "player_id", "team_id", "match_id", "match_date", "match_time", "home_name", "away_name", "home_score",
        "away_score", "status", "_line.goals", "_line.two_min", "_line.yellow", "_line.red",
    )


def recent_matches(log: DataFrame, k: int = 8) -> DataFrame:
    """Newest ``k`` matches of each player and team with the goal bar as a share of the best of them."""
    order = [F.desc("match_date"), F.desc("match_time"), F.desc("match_id")]
    newest = top_per_group(log, ["player_id", "team_id"], order, k, "recency")
    # At most ``k`` rows per player remain, in the order the positions left them in: the maximum needs no second sort and no join.
    best = F.greatest(F.lit(1), F.max("goals").over(Window.partitionBy("player_id", "team_id")))
    share = F.floor((F.col("goals") * 200 + F.col("_best")) / (F.col("_best") * 2))
    return newest.withColumn("_best", best).withColumn("bar", share.cast("bigint")).drop("_best")


def roster_by_position(sheet: DataFrame) -> DataFrame:
    """Roster of each team grouped by position, with the size of each group and shirt order inside it."""
    per_position = sheet.groupBy("team_id", "position").agg(F.count("*").alias("players"))
    listed = sheet.where(F.col("position").isin(*labels.POSITIONS)).select(
        "team_id", "position", "roster_id", "player_id", "player_name", "shirt",
        F.coalesce(F.col("shirt"), F.lit(NO_SHIRT_RANK)).alias("shirt_order"),
        F.array_position(F.array(*[F.lit(p) for p in labels.POSITIONS]), F.col("position")).alias("position_order"),
    )
    return listed.join(per_position, ["team_id", "position"])
