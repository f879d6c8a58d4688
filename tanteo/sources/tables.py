"""Reading league tables and loading a season."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanteo.functions.numbers import to_id
from tanteo.operators.silver import field
from tanteo.schemas import ALIASES


def scan_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, equals: Mapping[str, object] | None = None
) -> DataFrame:
    """Parquet scan with the projection and equality filters pushed into the reader."""
    df = spark.read.parquet(path)
    for column, value in (equals or {}).items():
        df = df.where(F.col(column) == value)
    return df.select(*columns) if columns else df


def scan_jdbc(
    spark: SparkSession, url: str, table: str, bounds: tuple[int, int], partitions: int, key: str = "id", **options: str
) -> DataFrame:
    """Database table read in parallel slices of its numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
                 numPartitions=partitions, **options)
        .load()
    )


def scan_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in a one-column frame of ids. Ids are compared as numbers: a text that is none matches nothing."""
    wanted = ids.select(to_id(F.col(ids.columns[0])).alias("_wanted")).where("_wanted is not null")
    return df.join(wanted, to_id(F.col(key)) == F.col("_wanted"), "left_semi")


def count_exact(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def season_matches(partidos: DataFrame, season_id: int, teams: DataFrame) -> DataFrame:
    """Raw matches of a season whose both teams belong to it; a table without a season column is read whole."""
    season = partidos.where(F.col("temporada_id") == season_id) if "temporada_id" in partidos.columns else partidos
    ids = teams.select(to_id(F.col("id")).alias("_team"))
    for side in ("local_equipo_id", "visitante_equipo_id"):
        team = to_id(field(season, ALIASES[side]))
        season = season.withColumn("_side", team).join(ids, F.col("_side") == F.col("_team"), "left_semi")
    return season.drop("_side")


def _lines_of(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Raw player lines of these matches, of a team that plays there."""
    teams = [to_id(field(matches, ALIASES[side])) for side in ("local_equipo_id", "visitante_equipo_id")]
    sides = matches.select(to_id(F.col("id")).alias("_match"), F.explode(F.array_distinct(F.array(*teams))).alias("_team"))
    mine = (to_id(F.col("partido_id")) == F.col("_match")) & (to_id(F.col("equipo_id")) == F.col("_team"))
    return lines.join(sides, mine, "left_semi")


def season_dataset(tables: Mapping[str, DataFrame], season_id: int) -> dict[str, DataFrame]:
    """Everything one season needs: teams of known clubs, then what hangs on those teams, then their players."""
    if season_id <= 0:
        raise ValueError("season_id must be a positive number")
    clubs = tables["clubes"]
    teams = scan_by_ids(
        tables["equipos"].where((F.col("temporada_id") == season_id) & to_id(F.col("id")).isNotNull()),
        "club_id",
        clubs.select("id"),
    )
    team_ids = teams.select("id")
    rosters = scan_by_ids(tables["planteles"], "equipo_id", team_ids)
    matches = season_matches(tables["partidos"], season_id, teams)
    return {
        "equipos": teams,
        "clubes": scan_by_ids(clubs, "id", teams.select("club_id")),
        "planteles": rosters,
        "partidos": matches,
        "participaciones": _lines_of(tables["participaciones"], matches),
        "jugadores": scan_by_ids(tables["jugadores"], "id", rosters.select("jugador_id")),
    }
