"""Report tables as exported, with the headings of each report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.functions.web import is_json, response_state


def players_report(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        F.col("player_name").alias("Jugador"), F.col("club").alias("Club"), F.col("shirt").alias("Dorsal"),
        F.col("position").alias("Posición"), F.col("matches_played").alias("Partidos"), F.col("goals").alias("Goles"),
        F.col("goals_per_match").alias("Goles/Partido"), F.col("two_min").alias("2min"),
        F.col("yellow").alias("Amarillas"), F.col("red").alias("Rojas"),
    )


def matches_report(matches: DataFrame) -> DataFrame:
    return matches.select(
        F.col("match_date").alias("Fecha"), F.col("match_time").alias("Hora"), F.col("round_label").alias("Jornada"),
        F.col("home_name").alias("Local"), F.col("away_name").alias("Visitante"), F.col("status").alias("Estado"),
        F.col("home_score").alias("Goles local"), F.col("away_score").alias("Goles visitante"),
    )


def standings_report(standings: DataFrame) -> DataFrame:
    return standings.select(
        F.col("pos").alias("Posición"), F.col("name").alias("Club"), F.col("played").alias("PJ"),
        F.col("won").alias("PG"), F.col("drawn").alias("PE"), F.col("lost").alias("PP"), F.col("gf").alias("GF"),
        F.col("ga").alias("GC"), F.col("gd").alias("DIF"), F.col("points").alias("PTS"),
    )


def stats_report(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        F.col("player_name").alias("Jugador"), F.col("club").alias("Club"), F.col("matches_played").alias("Partidos"),
        F.col("goals").alias("Goles"), F.col("goals_per_match").alias("Goles/Partido"),
        F.col("sanctions").alias("Sanciones"),
    )


def probe_log(responses: DataFrame, sample: int | None = None) -> DataFrame:
    """State of each logged response (key, path, status, body); ``sample`` as in ``response_state``."""
    body = F.trim(F.coalesce("body", F.lit("")))
    return responses.select(
        "key", "path", "status", response_state(F.col("status"), F.col("body"), sample).alias("state"),
        is_json(body).alias("json_valid"), F.length(body).cast("bigint").alias("body_size"),
    )


def probe_report(log: DataFrame) -> DataFrame:
    """Responses per state; the paths of a state are the log rows with that state."""
    return log.groupBy("state").agg(F.count("*").alias("responses"), F.countDistinct("path").alias("paths"))
