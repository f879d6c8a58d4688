"""Match lists, results, upcoming matches and source links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions import labels
from tanteo.functions.dates import calendar_key
from tanteo.functions.web import safe_url
from tanteo.operators.ranking import top_overall, top_per_group


def calendar_order(newest_first: bool) -> list[Column]:
    key = calendar_key(F.col("match_date"), F.col("match_time"))
    return [key.desc(), F.desc("match_id")] if newest_first else [key.asc(), F.asc("match_id")]


def match_list(
    matches: DataFrame, status: str = "", club_id: int | None = None, newest_first: bool = True
) -> DataFrame:
    """Matches of a status and club (either side) in calendar order."""
    if status:
        matches = matches.where(F.col("status") == status)
    if club_id is not None:
        matches = matches.where((F.col("home_club_id") == club_id) | (F.col("away_club_id") == club_id))
    return matches.orderBy(*calendar_order(newest_first))


def last_results(matches: DataFrame, k: int = 3) -> DataFrame:
    return top_overall(matches.where(F.col("status") == labels.FINISHED), calendar_order(True), k)


def upcoming(matches: DataFrame, today: str, k: int = 4) -> DataFrame:
    return top_overall(_future(matches, today), calendar_order(False), k)


def _future(matches: DataFrame, today: str) -> DataFrame:
    return matches.where((F.col("status") != labels.FINISHED) & (F.col("match_date") >= today))


def _per_team(matches: DataFrame) -> DataFrame:
    """Each match once per team that plays it."""
    return matches.withColumn("team_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))))


def next_match(matches: DataFrame, today: str) -> DataFrame:
    """First unfinished match of each team from ``today`` on."""
    return top_per_group(_per_team(_future(matches, today)), ["team_id"], calendar_order(False), 1).drop("pos")


def source_links(matches: DataFrame) -> DataFrame:
    """Match links kept only when they are safe to follow."""
    return matches.withColumns({c: safe_url(F.col(c)) for c in ("fixture_url", "sheet_url", "video_url")})


def club_coverage(matches: DataFrame, rosters: DataFrame, teams: DataFrame) -> DataFrame:
    """Per team: matches, those with a valid fixture and sheet link, players loaded."""
    linked = _per_team(source_links(matches)).groupBy("team_id").agg(
        F.count("*").alias("matches"), F.count("fixture_url").alias("with_fixture"), F.count("sheet_url").alias("with_sheet")
    )
    loaded = rosters.groupBy("team_id").agg(F.count("*").alias("players"))
    columns = ("matches", "with_fixture", "with_sheet", "players")
    return (
        teams.select("team_id")
        .join(linked, "team_id", "left")
        .join(loaded, "team_id", "left")
        .select("team_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    )
