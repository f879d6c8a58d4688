"""Club names to clubs, and the teams and aliases learned from a federation's lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions.text import is_blank, normalize_key, null_if_blank
from tanteo.operators.quality import TEAM_IDENTITY
from tanteo.operators.ranking import packed, packed_second, ranked
from tanteo.session import cut

ALIAS_SOURCE = "importador"


def club_key(name: Column) -> Column:
    """Key club names are compared by."""
    return normalize_key(name)


def active_aliases(club_aliases: DataFrame, clubes: DataFrame) -> DataFrame:
    """Active aliases of active clubs."""
    clubs = clubes.where("activo").select(F.col("id").alias("club_id"), F.col("nombre").alias("club_nombre"))
    return club_aliases.where("activo").join(clubs, "club_id")


def alias_catalog(club_aliases: DataFrame, clubes: DataFrame) -> DataFrame:
    """Alias catalogue, longest alias first; a table with positions rather than one growing JSON value."""
    catalog = active_aliases(club_aliases, clubes).select(
        "club_id", "club_nombre", "alias", "alias_normalizado", "fuente"
    )
    order = [F.length("alias_normalizado").desc(), F.asc("alias_normalizado"), F.asc("club_id"), F.asc("alias")]
    return ranked(catalog, [], order)


def resolve_clubs(names: DataFrame, clubes: DataFrame, club_aliases: DataFrame, name: str = "club_nombre") -> DataFrame:
    """Add ``club_id``: an active club of that name (lowest id), else an active alias (lowest alias id), else null."""
    by_name = (
        clubes.where("activo").groupBy(club_key(F.col("nombre")).alias("_key")).agg(F.min("id").alias("_by_name"))
    )
    by_alias = (
        active_aliases(club_aliases, clubes)
        .groupBy(F.col("alias_normalizado").alias("_key"))
        .agg(packed_second(F.min(packed(F.col("id"), F.col("club_id")))).alias("_by_alias"))
    )
    return (
        names.withColumn("_key", club_key(F.col(name)))
        .join(by_name, "_key", "left")
        .join(by_alias, "_key", "left")
        .withColumn("club_id", F.coalesce("_by_name", "_by_alias"))
        .drop("_key", "_by_name", "_by_alias")
    )


def catalog_teams(equipos: DataFrame, season_id: int) -> DataFrame:
    """Active teams of a season keyed by their identity."""
    return equipos.where(F.col("activo") & (F.col("temporada_id") == season_id)).select(
        *TEAM_IDENTITY, F.col("id").alias("equipo_id")
    )


class TeamSync(NamedTuple):
    results: DataFrame
    teams: DataFrame
    aliases: DataFrame


def sync_teams(
    requests: DataFrame, temporadas: DataFrame, clubes: DataFrame, equipos: DataFrame, club_aliases: DataFrame
) -> TeamSync:
    """Find or create the team of each request (seq, club_nombre, temporada_id, categoria, division, rama, ...).

    Requests are applied in ``seq`` order: the first one of an identity creates the team, the last one names it.
    """
    seasons = temporadas.select(F.col("id").alias("_season"))
    asked = resolve_clubs(requests, clubes, club_aliases).join(
        seasons, F.col("temporada_id") == F.col("_season"), "left"
    )
    branch = F.upper(F.trim("rama"))
    season_text = F.coalesce(F.col("temporada_id").cast("string"), F.lit("null"))
    unknown = F.concat(
        F.lit("Club no reconocido: "), F.col("club_nombre"),
        F.lit(". Agregar alias confirmado antes de sincronizar."),
    )
    rules = [
        (is_blank(F.col("club_nombre")), F.lit("club_nombre requerido")),
        (F.col("_season").isNull(), F.concat(F.lit("temporada_id inexistente o requerido: "), season_text)),
        (is_blank(F.col("categoria")) | is_blank(F.col("division")), F.lit("categoria y division requeridas")),
        (~F.coalesce(branch.isin("M", "F"), F.lit(False)),
         F.concat(F.lit("rama invalida: "), F.coalesce("rama", F.lit("null")))),
        (F.col("club_id").isNull(), unknown),
    ]
    checked = cut(
        asked.withColumn("error", F.coalesce(*[F.when(bad, message) for bad, message in rules]))
        .drop("_season")
        .withColumns(
            {
                "categoria": F.trim("categoria"),
                "division": F.trim("division"),
                "rama": branch,
                "equipo_codigo": F.coalesce(F.upper(null_if_blank(F.col("equipo_codigo"))), F.lit("A")),
                "federation_name": F.coalesce(null_if_blank(F.col("nombre_federacion")), F.trim("club_nombre")),
            }
        )
    )
    valid = checked.where("error is null")
    identity = list(TEAM_IDENTITY)
    wanted = valid.groupBy(*identity).agg(
        F.min("seq").alias("first_seq"), F.max(F.struct("seq", "federation_name"))["federation_name"].alias("new_name")
    )
    stored = equipos.groupBy(*identity).agg(F.min("id").alias("equipo_id"))
    placed = wanted.join(stored, identity, "left")
    highest = equipos.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    created = ranked(placed.where("equipo_id is null"), [], [F.col("first_seq")], "position").withColumn(
        "equipo_id", highest + F.col("position")
    )
    resolved = placed.where("equipo_id is not null").withColumn("created", F.lit(False)).unionByName(
        created.drop("position").withColumn("created", F.lit(True))
    )
    results = checked.join(resolved, identity, "left").select(
        "seq", F.trim("club_nombre").alias("club_nombre"), *identity, "equipo_id",
        (F.coalesce("created", F.lit(False)) & (F.col("seq") == F.col("first_seq"))).alias("equipo_creado"), "error",
    )
    renamed = placed.where("equipo_id is not null").select(F.col("equipo_id").alias("id"), "new_name")
    teams = (
        equipos.join(renamed, "id", "left")
        .withColumns(
            {
                "nombre_federacion": F.coalesce("new_name", "nombre_federacion"),
                "activo": F.when(F.col("new_name").isNotNull(), True).otherwise(F.col("activo")),
            }
        )
        .select(*equipos.columns)
        .unionByName(
            created.select(
                F.col("equipo_id").alias("id"), *identity, F.col("new_name").alias("nombre_federacion"),
                F.lit(True).alias("activo"),
            )
        )
    )
    return TeamSync(results, teams, _learn_aliases(valid, club_aliases))


def _learn_aliases(valid: DataFrame, club_aliases: DataFrame) -> DataFrame:
    """Aliases plus the first spelling seen of every key not stored yet."""
    learned = valid.groupBy(club_key(F.col("club_nombre")).alias("alias_normalizado")).agg(
        F.min(F.struct("seq", "club_id", F.trim("club_nombre").alias("alias"))).alias("first")
    )
    fresh = learned.join(club_aliases.select("alias_normalizado"), "alias_normalizado", "left_anti")
    highest = club_aliases.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = ranked(fresh, [], [F.col("first.seq")], "position")
    return club_aliases.unionByName(
        numbered.select(
            (highest + F.col("position")).alias("id"), F.col("first.club_id").alias("club_id"),
            F.col("first.alias").alias("alias"), "alias_normalizado", F.lit(ALIAS_SOURCE).alias("fuente"),
            F.lit(True).alias("activo"),
        )
    )


def import_context(
    temporadas: DataFrame, clubes: DataFrame, equipos: DataFrame, partidos: DataFrame, club_aliases: DataFrame
) -> DataFrame:
    """One row per season: its metadata and the volumes an import starts from."""
    teams = equipos.where("activo").groupBy("temporada_id").agg(F.count("*").alias("equipos_activos_temporada"))
    matches = partidos.groupBy("temporada_id").agg(F.count("*").alias("partidos_temporada"))
    seasons = temporadas.withColumnsRenamed({"id": "temporada_id", "nombre": "temporada_nombre"})
    counted = seasons.join(teams, "temporada_id", "left").join(matches, "temporada_id", "left")
    return counted.select(
        "temporada_id", "temporada_nombre", "anio", "fase", "competencia_id", "fecha_inicio", "fecha_fin",
        clubes.where("activo").agg(F.count("*")).scalar().alias("clubes_activos"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("equipos_activos_temporada", "partidos_temporada")],
        club_aliases.where("activo").agg(F.count("*")).scalar().alias("aliases_activos"),
    )
