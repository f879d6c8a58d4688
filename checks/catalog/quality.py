"""Integrity checks, duplicates, coverage and season volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.league_sql import key
from checks.registry import query
from tanteo.operators import quality as ops
from tanteo.plans import reports, team_sync
from tanteo.sources.star_league import SEASON_ID

CHECKS = {
    "invalid_match_refs": "home_id IS NULL OR away_id IS NULL",
    "cross_scope_matches": "cross_scope",
    "same_team_matches": "local_equipo_id = visitante_equipo_id",
    "matches_missing_source_trace": "trim(coalesce(programacion_url, '')) = '' OR trim(coalesce(programacion_pdf_url, '')) = '' OR tipo_fuente IS NULL",
    "competition_season_mismatches": "season IS NOT NULL AND competencia_id IS DISTINCT FROM season_competition",
    "partial_score_matches": "(goles_local IS NULL) <> (goles_visitante IS NULL)",
    "programmed_matches_with_score": "estado = 'programado' AND (goles_local IS NOT NULL OR goles_visitante IS NOT NULL)",
    "finished_matches_without_score": "estado IN ('finalizado', 'final') AND (goles_local IS NULL OR goles_visitante IS NULL)",
    "unknown_source_type_matches": "tipo_fuente NOT IN ('fecha_normal', 'reprogramacion')",
}


def _facts(s):
    return ops.match_facts(s.partidos_defectuosos, s.equipos, s.temporadas)


def _register_check(name: str, condition: str) -> None:
    @query(name, f"SELECT id, temporada_id, local_equipo_id, visitante_equipo_id FROM r_facts WHERE {condition}")
    def offenders(s):
        return ops.offenders(_facts(s), name).select("id", "temporada_id", "local_equipo_id", "visitante_equipo_id")


for _name, _condition in CHECKS.items():
    _register_check(_name, _condition)

_CLUB_GROUPS = f"SELECT {key('nombre')} club_key, count(*) n FROM r_clubes GROUP BY 1 HAVING n > 1"
_TEAM_GROUPS = """SELECT club_id, temporada_id, categoria, division, rama, equipo_codigo, count(*) n FROM r_twins GROUP BY ALL HAVING n > 1"""
_MATCH_GROUPS = """SELECT temporada_id, fecha::VARCHAR fecha, hora, local_equipo_id, visitante_equipo_id, count(*) n FROM r_defectos
    GROUP BY ALL HAVING n > 1"""


@query("duplicate_club_groups", _CLUB_GROUPS)
def duplicate_clubs(s):
    return ops.duplicate_clubs(s.clubes)


@query(
    "duplicate_team_groups",
    "WITH r_twins AS (SELECT * FROM r_equipos UNION ALL SELECT * FROM r_equipos WHERE id % 41 = 0) " + _TEAM_GROUPS,
)
def duplicate_teams(s):
    return ops.duplicate_teams(s.equipos.unionByName(s.equipos.where("id % 41 = 0")))


@query("duplicate_match_groups", _MATCH_GROUPS)
def duplicate_matches(s):
    return ops.duplicate_matches(s.partidos_defectuosos)


@query("broken_refs", "SELECT id FROM r_facts WHERE home_id IS NULL OR away_id IS NULL")
def broken_refs(s):
    """Matches without one of their teams, by anti joins on each side."""
    return ops.broken_refs(s.partidos_defectuosos, s.equipos)


@query("null_safe_neq", "SELECT id FROM r_facts WHERE home_id IS NOT NULL AND away_id IS NOT NULL AND other_season")
def null_safe_neq(s):
    return ops.of_another_season(_facts(s)).select("id")


@query(
    "exists_checks",
    """SELECT id FROM r_defectos WHERE temporada_id IN (SELECT id FROM r_temporadas) AND local_equipo_id IN (SELECT id FROM r_equipos WHERE activo)
    AND visitante_equipo_id IN (SELECT id FROM r_equipos WHERE activo)""",
)
def exists_checks(s):
    return ops.importable(s.partidos_defectuosos, s.equipos, s.temporadas).select("id")


def _report(where: str) -> str:
    counters = ", ".join(f"count(*) FILTER ({c}) {name}" for name, c in CHECKS.items())
    zero = " AND ".join(
        f"{n} = 0" for n in ("duplicate_club_groups", "duplicate_team_groups", "exact_duplicate_match_groups", *CHECKS)
    )
    return f"""SELECT *, {zero} AND clubs_with_active_alias = active_clubs ok FROM (SELECT (SELECT count(*) FROM ({_CLUB_GROUPS})) duplicate_club_groups, 0::BIGINT duplicate_team_groups,
    (SELECT count(*) FROM ({_MATCH_GROUPS.replace('GROUP BY', f'WHERE {where} GROUP BY')})) exact_duplicate_match_groups,
    (SELECT count(*) FROM r_clubes WHERE activo) active_clubs, (SELECT count(DISTINCT club_id) FROM r_club_aliases WHERE activo) clubs_with_active_alias,
    (SELECT count(*) FROM r_club_aliases WHERE activo) active_aliases, count(*) matches, {counters} FROM r_facts WHERE {where})"""


@query("integrity_report", f"SELECT *, 3::BIGINT temporada_id FROM ({_report('temporada_id = 3')})")
def integrity_report(s):
    return ops.integrity_report(
        s.clubes, s.equipos, s.partidos_defectuosos, s.temporadas, s.club_aliases, SEASON_ID
    )


@query("integrity_report_all_seasons", f"SELECT *, NULL::BIGINT temporada_id FROM ({_report('true')})")
def integrity_report_all(s):
    return ops.integrity_report(s.clubes, s.equipos, s.partidos_defectuosos, s.temporadas, s.club_aliases)


@query(
    "integrity_script",
    f"""SELECT duplicate_club_groups, duplicate_team_groups, exact_duplicate_match_groups, invalid_match_refs, cross_scope_matches, same_team_matches
    FROM ({_report('true')})""",
)
def integrity_script(s):
    return ops.integrity_script(s.clubes, s.equipos, s.partidos_defectuosos, s.temporadas)


_SEASONS = """SELECT t.id temporada_id, t.nombre, coalesce(equipos, 0) equipos, coalesce(partidos, 0) partidos, primera_fecha, ultima_fecha FROM r_temporadas t
    LEFT JOIN (SELECT temporada_id, count(DISTINCT id) equipos FROM r_equipos GROUP BY 1) e ON e.temporada_id = t.id
    LEFT JOIN (SELECT temporada_id, count(DISTINCT id) partidos, min(fecha)::VARCHAR primera_fecha, max(fecha)::VARCHAR ultima_fecha
      FROM r_defectos GROUP BY 1) p ON p.temporada_id = t.id"""


@query("season_counts", _SEASONS)
def season_counts(s):
    return ops.season_counts(s.temporadas, s.equipos, s.partidos_defectuosos)


@query("season_fanout", f"SELECT temporada_id, equipos, partidos FROM ({_SEASONS})")
def season_fanout(s):
    return ops.season_counts(s.temporadas, s.equipos, s.partidos_defectuosos).select("temporada_id", "equipos", "partidos")


@query(
    "alias_coverage",
    """SELECT count(*) total_aliases, count(*) FILTER (activo) active_aliases, count(DISTINCT club_id) FILTER (activo) clubs_with_active_alias
    FROM r_club_aliases""",
)
def alias_coverage(s):
    return ops.alias_coverage(s.club_aliases)


_ACTIVE_ALIASES = """SELECT a.*, c.nombre club_nombre FROM r_club_aliases a JOIN r_clubes c ON c.id = club_id WHERE a.activo AND c.activo"""


@query("alias_club", f"SELECT id, club_id, club_nombre, alias FROM ({_ACTIVE_ALIASES})")
def alias_club(s):
    return team_sync.active_aliases(s.club_aliases, s.clubes).select("id", "club_id", "club_nombre", "alias")


@query(
    "alias_catalog",
    f"""SELECT club_id, club_nombre, alias, alias_normalizado, fuente, row_number() OVER (ORDER BY length(alias_normalizado) DESC,
    alias_normalizado, club_id, alias) pos FROM ({_ACTIVE_ALIASES})""",
)
def alias_catalog(s):
    return team_sync.alias_catalog(s.club_aliases, s.clubes)


@query(
    "scope_overlap_pairs",
    """SELECT least(home_club_id, away_club_id) club_a, greatest(home_club_id, away_club_id) club_b, count(DISTINCT home_scope) scopes
    FROM s_matches WHERE home_scope = away_scope GROUP BY 1, 2 HAVING scopes > 1""",
)
def scope_overlap_pairs(s):
    return ops.scope_overlap_pairs(s.matches)


@query(
    "match_scope_rules",
    """SELECT id match_id, CASE WHEN season IS NULL THEN 'Temporada inexistente: ' || temporada_id
    WHEN competencia_id IS DISTINCT FROM season_competition THEN 'competencia_id (' || competencia_id || ') no corresponde a temporada ' || temporada_id ||
      ' (competencia esperada ' || season_competition || ')'
    WHEN local_equipo_id = visitante_equipo_id THEN 'Local y visitante no pueden ser el mismo equipo'
    WHEN home_id IS NULL THEN 'Equipo local inexistente: ' || local_equipo_id WHEN away_id IS NULL THEN 'Equipo visitante inexistente: ' || visitante_equipo_id
    WHEN other_season THEN 'Los equipos deben pertenecer a la temporada del partido (' || temporada_id || ')'
    WHEN cross_scope THEN 'Local y visitante deben pertenecer al mismo scope competitivo' END error FROM r_facts WHERE error IS NOT NULL""",
)
def match_scope_rules(s):
    return ops.match_scope_violations(s.partidos_defectuosos, s.equipos, s.temporadas)


@query(
    "import_context",
    """SELECT t.id temporada_id, t.nombre temporada_nombre, anio, fase, t.competencia_id, fecha_inicio::VARCHAR fecha_inicio, fecha_fin::VARCHAR fecha_fin,
    (SELECT count(*) FROM r_clubes WHERE activo) clubes_activos,
    (SELECT count(*) FROM r_equipos e WHERE e.temporada_id = t.id AND activo) equipos_activos_temporada,
    (SELECT count(*) FROM r_partidos p WHERE p.temporada_id = t.id) partidos_temporada,
    (SELECT count(*) FROM r_club_aliases WHERE activo) aliases_activos FROM r_temporadas t""",
)
def import_context(s):
    return team_sync.import_context(s.temporadas, s.clubes, s.equipos, s.partidos, s.club_aliases)


@query(
    "catalog_teams",
    """SELECT club_id, temporada_id, categoria, division, rama, equipo_codigo, id equipo_id FROM r_equipos WHERE activo AND temporada_id = 3""",
)
def catalog_teams(s):
    return team_sync.catalog_teams(s.equipos, SEASON_ID)


_STATE = """CASE WHEN event_id % 4 = 1 OR event_id % 20 = 8 AND event_id % 3 <> 0 THEN 'auth_required'
    WHEN event_id % 4 = 2 OR event_id % 20 = 4 AND event_id % 3 <> 0 THEN 'not_found'
    WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'public_json' ELSE 'public_non_json' END ELSE 'transport_or_server_error' END"""


@query(
    "probe_log",
    f"""SELECT event_id::VARCHAR AS key, '/' || event_type AS path, ([200, 401, 404, 500])[event_id % 4 + 1]::BIGINT status, {_STATE} state,
    event_id % 3 = 0 json_valid, length(CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 20 = 4 THEN '<pre>Cannot GET /x</pre>'
    WHEN event_id % 20 = 8 THEN 'Missing Token' ELSE '<html>ok</html>' END)::BIGINT body_size FROM events""",
)
def probe_log(s):
    return reports.probe_log(s.respuestas, 2000)


@query(
    "probe_log_report",
    f"SELECT {_STATE} state, count(*) responses, count(DISTINCT event_type) paths FROM events GROUP BY 1",
)
def probe_report(s):
    return reports.probe_report(reports.probe_log(s.respuestas, 2000))
