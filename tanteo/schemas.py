"""Schemas of the league tables and the column spellings accepted on read."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "bigint": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "date": DateType(),
    "double": DoubleType(), "timestamp": TimestampType(),
}


def _table(columns: str) -> StructType:
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


CLUBES = _table(
    "id bigint, nombre string, abreviatura string, ciudad string, logo_url string, activo boolean"
)
EQUIPOS = _table(
    "id bigint, club_id bigint, temporada_id bigint, categoria string, division string, rama string, "
    "equipo_codigo string, nombre_federacion string, activo boolean"
)
JUGADORES = _table(
    "id bigint, nombre string, apellido string, fecha_nacimiento date, brazo_habil string, "
    "altura_cm double, peso_kg double"
)
PLANTELES = _table("id bigint, jugador_id bigint, equipo_id bigint, dorsal int, posicion string")
PARTIDOS = _table(
    "id bigint, competencia_id bigint, temporada_id bigint, fecha date, hora string, jornada int, "
    "local_equipo_id bigint, visitante_equipo_id bigint, estado string, goles_local int, goles_visitante int, "
    "observaciones string, programacion_url string, programacion_pdf_url string, tipo_fuente string, "
    "planilla_url string, video_url string, updated_at timestamp"
)
PARTICIPACIONES = _table(
    "id bigint, partido_id bigint, jugador_id bigint, equipo_id bigint, goles int, exclusiones_2min int, "
    "tarjeta_amarilla int, tarjeta_roja int, asistencias int, lanzamientos int, atajadas int, dorsal_utilizado int, "
    "tarjeta_azul int"
)
TEMPORADAS = _table(
    "id bigint, nombre string, anio int, fase string, competencia_id bigint, fecha_inicio date, fecha_fin date"
)
CLUB_ALIASES = _table(
    "id bigint, club_id bigint, alias string, alias_normalizado string, fuente string, activo boolean"
)
IMPORT_REVISION = _table(
    "fingerprint string, tipo string, fuente_url string, fuente_pdf_url string, payload string, estado string, "
    "observaciones string"
)

# Spellings accepted for a column, the first non-empty one wins.
ALIASES = {
    "local_equipo_id": ("local_equipo_id", "local_id"),
    "visitante_equipo_id": ("visitante_equipo_id", "visitante_id"),
    "jornada": ("jornada", "fecha_torneo"),
    "observaciones": ("observaciones", "notas"),
    "planilla_url": ("fuente_planilla", "planilla_url", "url_planilla", "link_planilla"),
    "video_url": ("fuente_video", "video_url", "url_video", "link_video"),
    "exclusiones_2min": ("exclusiones_2min", "dos_minutos"),
    "tarjeta_amarilla": ("tarjeta_amarilla", "amarillas"),
    "tarjeta_roja": ("tarjeta_roja", "rojas"),
    "asistencias": ("asistencias", "assists"),
    "lanzamientos": ("lanzamientos", "tiros", "shots"),
    "atajadas": ("atajadas", "paradas", "saves"),
}

# The sporting unit a table is ranked over.
SCOPE = ("season_id", "branch", "category", "division")
