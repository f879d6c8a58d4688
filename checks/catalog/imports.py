"""Fixture publications, batch checks, synchronisation and team sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.league_sql import key, pick, time_of
from checks.registry import query
from tanteo.plans import fixture_import, import_job, publications, team_sync
from tanteo.session import scratch_dir
from tanteo.sources import star_league as star
from tanteo.sources.payload import fixture_rows
from tanteo.sources.snapshots import SnapshotStore
from tanteo.streaming.fixture_feed import start_feed

# --- publications ------------------------------------------------------------------------------------------------


@query(
    "fixture_scope_key",
    """SELECT seq, scope, CASE WHEN error IS NULL AND tipo_fuente = 'otro' THEN 'tipo_fuente inválido: otro' ELSE error END error FROM s_publications""",
)
def fixture_scope_key(s):
    return publications.identified(s.publicaciones).select("seq", "scope", "error")


@query("schedule_key", "SELECT seq, schedule FROM s_publications")
def schedule_key(s):
    return s.publicaciones.select("seq", publications.schedule_key().alias("schedule"))


_PICK = "CASE WHEN moves = 1 THEN moved ELSE normal END"


@query(
    "prioritize_selected",
    f"""SELECT scope, ({_PICK}).seq seq, ({_PICK}).fecha fecha, ({_PICK}).hora hora,
    CASE WHEN moves = 1 THEN 'reprogramacion' ELSE 'fecha_normal' END fuente_priorizada, versiones_detectadas,
    CASE WHEN moves = 1 AND normals = 1 THEN normal.fecha END fecha_programacion_original,
    CASE WHEN moves = 1 AND normals = 1 THEN normal.hora END hora_programacion_original
    FROM s_matchups WHERE moves = 1 OR (moves = 0 AND normals = 1)""",
)
def prioritize_selected(s):
    selected = publications.prioritize(s.publicaciones).selected
    return selected.select(
        "scope", "seq", "fecha", "hora", "fuente_priorizada", "versiones_detectadas", "fecha_programacion_original",
        "hora_programacion_original",
    )


@query(
    "prioritize_ambiguous",
    """SELECT scope, CASE WHEN moves > 1 THEN 'multiples_reprogramaciones' ELSE 'mismo_cruce_repetido' END tipo, versiones_detectadas
    FROM s_matchups WHERE moves > 1 OR (moves = 0 AND normals > 1)""",
)
def prioritize_ambiguous(s):
    return publications.prioritize(s.publicaciones).ambiguous


@query(
    "prioritize_rejected",
    """SELECT seq, coalesce(error, 'tipo_fuente inválido: otro') error FROM s_publications WHERE error IS NOT NULL OR tipo_fuente = 'otro'""",
)
def prioritize_rejected(s):
    return publications.prioritize(s.publicaciones).rejected.select("seq", "error")


@query(
    "ambiguous_versions",
    """SELECT seq, scope, CASE WHEN moves > 1 THEN 'multiples_reprogramaciones' ELSE 'mismo_cruce_repetido' END tipo
    FROM s_publications JOIN s_matchups USING (scope) WHERE error IS NULL AND tipo_fuente <> 'otro' AND (moves > 1 OR (moves = 0 AND normals > 1))""",
)
def ambiguous_versions(s):
    found = publications.prioritize(s.publicaciones).ambiguous
    return publications.ambiguous_versions(s.publicaciones, found).select("seq", "scope", "tipo")


@query(
    "identification_coverage",
    """SELECT count(*) total, count(*) FILTER (local_equipo_id > 0 AND visitante_equipo_id > 0) identified,
    floor(identified * 1000 / total) / 10.0 coverage_pct, identified = total write_allowed FROM r_publicaciones""",
)
def identification_coverage(s):
    return publications.identification_coverage(s.publicaciones)


@query(
    "volume_baseline",
    """SELECT coalesce(r.temporada_id, p.temporada_id) temporada_id, coalesce(received, 0) received, coalesce(expected, 0) expected,
    abs(coalesce(received, 0) - coalesce(expected, 0)) * 100 > coalesce(expected, 0) * 5 alert FROM
    (SELECT temporada_id, count(*) received FROM r_defectos GROUP BY 1) r FULL JOIN (SELECT temporada_id, count(*) expected FROM r_partidos GROUP BY 1) p
    ON p.temporada_id = r.temporada_id""",
)
def volume_baseline(s):
    return publications.volume_baseline(s.partidos_defectuosos, s.partidos)


# --- batches -----------------------------------------------------------------------------------------------------

_BATCH_ROWS = f"""(SELECT *, match_key // 5 batch_id, row_number() OVER (PARTITION BY match_key // 5 ORDER BY match_key) idx,
    CASE WHEN match_key % 71 = 0 THEN 9 ELSE 3 END competencia_id, CASE WHEN match_key % 61 = 0 THEN away ELSE home END local_id,
    CASE WHEN match_key % 83 = 0 THEN NULL ELSE {time_of('match_key + 1')} END hora, match_key % 83 = 0 bad_time, match_key % 30 + 1 jornada,
    CASE WHEN match_key % 73 = 0 THEN 'otro' WHEN match_key % 4 = 0 THEN 'reprogramacion' ELSE 'fecha_normal' END tipo_fuente
    FROM r_pairings WHERE match_key // 5 % 53 <> 0 AND match_key // 5 % 59 <> 0)"""
_CHECKED = f"""(SELECT *, CASE WHEN local_id <= 0 OR away <= 0 THEN 'IDs de equipos inválidos' WHEN local_id = away THEN 'Local y visitante no pueden ser el mismo equipo'
    WHEN tipo_fuente = 'otro' THEN 'tipo_fuente inválido: otro' WHEN match_key % 67 = 0 THEN 'programacion_pdf_url requerida'
    WHEN competencia_id = 9 THEN 'competencia 9 no corresponde a temporada 3' WHEN local_id % 23 = 0 OR away % 23 = 0 THEN 'equipo inexistente o inactivo'
    WHEN bad_time THEN 'hora inválida' END error FROM {_BATCH_ROWS})"""
_VERDICTS = f"""(SELECT match_key // 5 batch_id, any_value(match_key // 5 % 53 = 0) is_empty, any_value(match_key // 5 % 59 = 0) not_array, count(*) n,
    coalesce(any_value(broken), 0) broken, coalesce(any_value(dups), 0) dups, coalesce(any_value(ambiguous), 0) ambiguous FROM r_pairings LEFT JOIN (
      SELECT batch_id b, sum(broken)::BIGINT broken, sum(dups)::BIGINT dups, count(*) FILTER (schedules > 1) ambiguous FROM (
        SELECT batch_id, local_id, away, sum(broken)::BIGINT broken, count(*) FILTER (n > 1) dups, count(DISTINCT (odate, t)) schedules FROM (
          SELECT batch_id, local_id, away, odate, coalesce(hora, '00:00:00') t, tipo_fuente, count(*) n, count(error) broken FROM {_CHECKED} GROUP BY ALL)
        GROUP BY ALL) GROUP BY 1) ON b = match_key // 5 GROUP BY 1)"""
_VERDICT = f"""(SELECT batch_id, CASE WHEN not_array AND NOT is_empty THEN 0 WHEN is_empty THEN 0 ELSE n END total,
    CASE WHEN not_array OR is_empty THEN 1 ELSE broken END invalidos,
    CASE WHEN not_array OR is_empty OR broken > 0 THEN 0 ELSE dups END duplicate_payload_groups,
    CASE WHEN not_array OR is_empty OR broken > 0 THEN 0 ELSE ambiguous END ambiguous_schedule_pairs,
    CASE WHEN is_empty THEN 'lote vacío' WHEN not_array THEN 'p_partidos debe ser un array JSON' END error FROM {_VERDICTS})"""
_OK = f"(SELECT batch_id FROM {_VERDICT} WHERE invalidos = 0 AND duplicate_payload_groups = 0 AND ambiguous_schedule_pairs = 0)"


#: The most fixtures that the stored procedure takes at once.
BATCH_LIMIT = 200


def _preflight(s):
    return fixture_import.preflight(s.lotes, s.temporadas, s.equipos, BATCH_LIMIT)


@query(
    "preflight_rows",
    f"""SELECT batch_id, idx indice, error, local_id::VARCHAR local_equipo_id, away::VARCHAR visitante_equipo_id, odate::VARCHAR fecha
    FROM {_CHECKED} WHERE error IS NOT NULL""",
)
def preflight_rows(s):
    return fixture_import.preflight_errors(_preflight(s)[1])


@query(
    "preflight_batch",
    f"""SELECT *, invalidos = 0 AND duplicate_payload_groups = 0 AND ambiguous_schedule_pairs = 0 ok FROM {_VERDICT}""",
)
def preflight_batch(s):
    return _preflight(s)[0]


@query("sync_gate", f"SELECT batch_id, idx FROM {_CHECKED} WHERE batch_id IN {_OK}")
def sync_gate(s):
    verdicts, checked = _preflight(s)
    return fixture_import.gate(checked, verdicts).select("batch_id", "idx")


# Stored matches: every second one the other way round, so that the load inserts, refreshes, reschedules and reviews.
_STORED = """(SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN local_equipo_id ELSE visitante_equipo_id END AS local_equipo_id,
    CASE WHEN id % 2 = 0 THEN visitante_equipo_id ELSE local_equipo_id END AS visitante_equipo_id) FROM r_partidos)"""
_DECISIONS = f"""(SELECT *, CASE WHEN stored > 1 THEN 'revision' WHEN stored IS NULL AND turn = 1 THEN 'insertado'
    WHEN odate IS NOT DISTINCT FROM cur_fecha AND hora IS NOT DISTINCT FROM cur_hora THEN 'ya_existente' WHEN movable THEN 'reprogramado'
    ELSE 'revision' END accion FROM (SELECT *, CASE WHEN movable AND turn > 1 THEN prev_fecha WHEN stored = 1 THEN old_fecha END cur_fecha,
      CASE WHEN movable AND turn > 1 THEN prev_hora WHEN stored = 1 THEN old_hora END cur_hora FROM (
        SELECT r.*, stored, old_fecha, old_hora, old_id, stored IS NULL OR (stored = 1 AND coalesce(estado = 'programado', false)) movable,
        row_number() OVER w turn, lag(odate) OVER w prev_fecha, lag(hora) OVER w prev_hora FROM {_BATCH_ROWS} r
        LEFT JOIN (SELECT local_equipo_id l, visitante_equipo_id v, count(*) stored, min(fecha) old_fecha, min(hora) old_hora, min(id) old_id, min(estado) estado
          FROM {_STORED} GROUP BY 1, 2) ON l = local_id AND v = away WHERE batch_id IN {_OK}
        WINDOW w AS (PARTITION BY local_id, away ORDER BY batch_id, idx))))"""


def _accepted(s):
    verdicts, checked = _preflight(s)
    return fixture_import.gate(checked, verdicts)


def _queue(s):
    """Review queue before the load: an old entry for the schedule of every match."""
    mark = F.expr(
        "md5(concat_ws('|', 'partido_cruce_ambiguo', temporada_id, local_equipo_id, visitante_equipo_id, fecha, hora))"
    )
    return s.partidos.groupBy(mark.alias("fingerprint")).agg(F.min("id").alias("id")).selectExpr(
        "fingerprint", "'partido_cruce_ambiguo' AS tipo", "'vieja' AS fuente_url", "'vieja' AS fuente_pdf_url",
        "'{}' AS payload", "'resuelto' AS estado", "cast(id as string) AS observaciones",
    )


def _sync(s):
    return fixture_import.sync_matches(_accepted(s), s.partidos_previos, _queue(s), star.RUN_AT)


@query(
    "sync_matches",
    f"""SELECT batch_id, idx, turn, accion, coalesce(stored, 0) stored, cur_fecha::VARCHAR fecha_anterior, cur_hora hora_anterior FROM {_DECISIONS}""",
)
def sync_matches(s):
    decisions = fixture_import.sync_decisions(_accepted(s), s.partidos_previos)
    return decisions.select("batch_id", "idx", "turn", "accion", "stored", "fecha_anterior", "hora_anterior")


@query(
    "sync_counters",
    f"""SELECT batch_id, count(*) total_recibidos, count(*) FILTER (accion = 'insertado') insertados, count(*) FILTER (accion = 'ya_existente') ya_existentes,
    count(*) FILTER (accion = 'reprogramado') reprogramados, count(*) FILTER (accion = 'revision') revision, 0::BIGINT errores
    FROM {_DECISIONS} GROUP BY 1""",
)
def sync_counters(s):
    return fixture_import.sync_counters(fixture_import.sync_decisions(_accepted(s), s.partidos_previos))


_PAIRS = f"""(SELECT local_id, away, arg_max(odate, turn) fecha, max({{'t': turn, 'h': hora, 'u': match_key, 'k': tipo_fuente}}) last, arg_max(jornada, turn) jornada,
    max({{'t': turn, 'f': cur_fecha, 'h': cur_hora}}) FILTER (accion = 'reprogramado') moved, min({{'b': batch_id, 'i': idx}}) FILTER (accion = 'insertado') born
    FROM {_DECISIONS} WHERE accion <> 'revision' GROUP BY 1, 2)"""
_MOVED_NOTE = "'Reprogramado automáticamente desde la federación. Fecha anterior: ' || moved.f || ' ' || coalesce(moved.h[1:5], 'sin hora')"


_MATCHES_AFTER = f"""WITH pairs AS {_PAIRS} SELECT id, local_equipo_id, visitante_equipo_id, coalesce(p.fecha, m.fecha)::VARCHAR fecha,
    CASE WHEN p.fecha IS NULL THEN hora ELSE last.h END hora, coalesce(p.jornada, m.jornada) jornada, estado, goles_local,
    coalesce({_MOVED_NOTE}, observaciones) observaciones, coalesce('https://liga.example/n/' || last.u, programacion_url) programacion_url,
    coalesce(last.k, tipo_fuente) tipo_fuente, strftime(CASE WHEN p.fecha IS NULL THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '{star.RUN_AT}' END, '%Y-%m-%d %H:%M:%S') updated_at
    FROM {_STORED} m LEFT JOIN pairs p ON born IS NULL AND local_id = local_equipo_id AND away = visitante_equipo_id
    UNION ALL SELECT (SELECT max(id) FROM {_STORED}) + row_number() OVER (ORDER BY born.b, born.i), local_id, away, fecha::VARCHAR, last.h, jornada, 'programado', NULL,
    coalesce({_MOVED_NOTE}, 'Importado automáticamente desde programación oficial de la federación'), 'https://liga.example/n/' || last.u, last.k,
    '{star.RUN_AT}' FROM pairs WHERE born IS NOT NULL"""


def _matches_after(table):
    return table.select(
        "id", "local_equipo_id", "visitante_equipo_id", "fecha", "hora", "jornada", "estado", "goles_local",
        "observaciones", "programacion_url", "tipo_fuente", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


@query("sync_matches_table", _MATCHES_AFTER)
def sync_matches_table(s):
    return _matches_after(_sync(s).matches)


def _fed(s):
    """A store whose league has taken all batches from the feed's folder."""
    root = f"{scratch_dir(s.spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    store = SnapshotStore(s.spark, f"{root}/store")
    league = {"temporadas": s.temporadas, "equipos": s.equipos, "partidos": s.partidos_previos, "import_revision": _queue(s)}
    import_job.open_league(store, league)
    s.lotes.write.json(f"{root}/feed")
    start_feed(store, f"{root}/feed", f"{root}/checkpoint", star.RUN_AT, BATCH_LIMIT).awaitTermination()
    return store


@query("feed_matches_table", _MATCHES_AFTER)
def feed_matches_table(s):
    """The stream leaves the matches that one load leaves."""
    return _matches_after(_fed(s).read("partidos"))


@query(
    "import_log",
    f"""SELECT v.batch_id, total, invalidos, duplicate_payload_groups, ambiguous_schedule_pairs, error,
    invalidos = 0 AND duplicate_payload_groups = 0 AND ambiguous_schedule_pairs = 0 ok, insertados, ya_existentes, reprogramados, revision
    FROM {_VERDICT} v LEFT JOIN (SELECT batch_id, count(*) FILTER (accion = 'insertado') insertados, count(*) FILTER (accion = 'ya_existente') ya_existentes,
    count(*) FILTER (accion = 'reprogramado') reprogramados, count(*) FILTER (accion = 'revision') revision FROM {_DECISIONS} GROUP BY 1) USING (batch_id)""",
)
def import_log(s):
    log = _fed(s).read("import_log")
    return log.select(
        "batch_id", "total", "invalidos", "duplicate_payload_groups", "ambiguous_schedule_pairs", "error", "ok", "insertados",
        "ya_existentes", "reprogramados", "revision",
    )


_REVIEWS = f"""(SELECT md5(concat_ws('|', tipo, 3, local_id, away, odate, hora)) fingerprint, * FROM (
    SELECT *, CASE WHEN stored > 1 THEN 'partido_cruce_ambiguo' ELSE 'partido_finalizado_fecha_distinta' END tipo FROM {_DECISIONS} WHERE accion = 'revision'))"""
_OLD_QUEUE = """(SELECT md5(concat_ws('|', 'partido_cruce_ambiguo', temporada_id, local_equipo_id, visitante_equipo_id, fecha, hora)) fingerprint,
    min(id)::VARCHAR observaciones FROM r_partidos GROUP BY 1)"""


@query(
    "review_queue",
    f"""SELECT coalesce(q.fingerprint, r.fingerprint) fingerprint, coalesce(r.tipo, 'partido_cruce_ambiguo') tipo,
    CASE WHEN r.fingerprint IS NULL THEN 'vieja' ELSE 'https://liga.example/n/' || r.u END fuente_url,
    CASE WHEN q.fingerprint IS NULL THEN 'pendiente' ELSE 'resuelto' END estado,
    coalesce(q.observaciones, CASE WHEN r.stored > 1 THEN 'Existen ' || r.stored || ' partidos con el mismo cruce en la temporada; no se modificó automáticamente.'
      ELSE 'La programación difiere de un partido ya no programado; no se modificó automáticamente.' END) observaciones
    FROM {_OLD_QUEUE} q FULL JOIN (SELECT fingerprint, any_value(tipo) tipo, any_value(stored) stored, arg_max(match_key, batch_id * 1000 + idx) u
      FROM {_REVIEWS} GROUP BY 1) r ON r.fingerprint = q.fingerprint""",
)
def review_queue(s):
    return _sync(s).reviews.select("fingerprint", "tipo", "fuente_url", "estado", "observaciones")


# --- clubs and teams ---------------------------------------------------------------------------------------------

# A request per customer: its club under one of four spellings, some of them unknown, some rows incomplete.
_REQUESTS = f"""(SELECT c_custkey seq, CASE c_custkey % 8 WHEN 7 THEN 'Desconocido' WHEN 6 THEN ' ' WHEN 5 THEN 'CN ' || (c_custkey // 4)
    WHEN 4 THEN 'alias  NORTE ' || (c_custkey // 4) ELSE upper(nombre) END club_nombre, CASE WHEN c_custkey % 31 = 0 THEN 77 ELSE 3 END temporada_id,
    {pick(star.CATEGORIES, 'c_custkey')} categoria, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE {pick(star.DIVISIONS, 'c_custkey // 2')} END division,
    CASE WHEN c_custkey % 41 = 0 THEN 'x' WHEN c_custkey % 2 = 0 THEN ' m' ELSE 'F' END rama,
    (['', 'b', 'C', 'D'])[c_custkey % 4 + 1] equipo_codigo FROM customer JOIN r_clubes ON id = c_custkey // 4)"""
_RESOLVED = f"""(SELECT q.*, coalesce(n.club_id, a.club_id) club_id FROM {_REQUESTS} q
    LEFT JOIN (SELECT {key('nombre')} k, min(id) club_id FROM r_clubes WHERE activo GROUP BY 1) n ON n.k = {key('club_nombre')}
    LEFT JOIN (SELECT alias_normalizado k, arg_min(club_id, al.id) club_id FROM r_club_aliases al JOIN r_clubes c ON c.id = al.club_id
      WHERE al.activo AND c.activo GROUP BY 1) a ON a.k = {key('club_nombre')})"""
_VALIDATED = f"""(SELECT seq, trim(club_nombre) club_nombre, temporada_id, categoria, division, upper(trim(rama)) rama,
    coalesce(nullif(upper(equipo_codigo), ''), 'A') equipo_codigo, club_id, CASE WHEN trim(club_nombre) = '' THEN 'club_nombre requerido'
    WHEN temporada_id = 77 THEN 'temporada_id inexistente o requerido: 77' WHEN division = '' THEN 'categoria y division requeridas'
    WHEN rama = 'x' THEN 'rama invalida: x' WHEN club_id IS NULL THEN 'Club no reconocido: ' || club_nombre || '. Agregar alias confirmado antes de sincronizar.'
    END error FROM {_RESOLVED})"""
_IDENTITY = "club_id, temporada_id, categoria, division, rama, equipo_codigo"
_TEAMS = f"""(SELECT {_IDENTITY}, first_seq, new_name, coalesce(old, (SELECT max(id) FROM r_equipos) + row_number() OVER (PARTITION BY old IS NULL ORDER BY first_seq)) equipo_id,
    old IS NULL created FROM (SELECT {_IDENTITY}, min(seq) first_seq, arg_max(club_nombre, seq) new_name FROM {_VALIDATED} WHERE error IS NULL GROUP BY ALL)
    LEFT JOIN (SELECT {_IDENTITY}, min(id) old FROM r_equipos GROUP BY ALL) USING ({_IDENTITY}))"""


def _requests(s):
    clubs = s.clubes.select(F.col("id").alias("club"), "nombre")
    rows = s.table("customer").selectExpr("c_custkey AS seq", "c_custkey div 4 AS club").join(clubs, "club")
    return rows.selectExpr(
        "seq",
        "CASE seq % 8 WHEN 7 THEN 'Desconocido' WHEN 6 THEN ' ' WHEN 5 THEN concat('CN ', club) "
        "WHEN 4 THEN concat('alias  NORTE ', club) ELSE upper(nombre) END AS club_nombre",
        "if(seq % 31 = 0, 77L, 3L) AS temporada_id",
        f"{star.pick(star.CATEGORIES, 'seq')} AS categoria",
        f"if(seq % 37 = 0, '', {star.pick(star.DIVISIONS, 'seq div 2')}) AS division",
        "CASE WHEN seq % 41 = 0 THEN 'x' WHEN seq % 2 = 0 THEN ' m' ELSE 'F' END AS rama",
        "element_at(array('', 'b', 'C', 'D'), cast(seq % 4 as int) + 1) AS equipo_codigo",
        "cast(NULL as string) AS nombre_federacion",
    )


def _team_sync(s):
    return team_sync.sync_teams(_requests(s), s.temporadas, s.clubes, s.equipos, s.club_aliases)


@query("resolve_club", f"SELECT seq, club_nombre, club_id FROM {_RESOLVED}")
def resolve_club(s):
    return team_sync.resolve_clubs(_requests(s), s.clubes, s.club_aliases).select("seq", "club_nombre", "club_id")


@query(
    "sync_teams",
    f"""SELECT v.seq, v.club_nombre, v.club_id, v.error, equipo_id, coalesce(created AND v.seq = first_seq, false) equipo_creado FROM {_VALIDATED} v
    LEFT JOIN {_TEAMS} t ON v.error IS NULL AND t.club_id = v.club_id AND t.temporada_id = v.temporada_id AND t.categoria = v.categoria
    AND t.division = v.division AND t.rama = v.rama AND t.equipo_codigo = v.equipo_codigo""",
)
def sync_teams(s):
    return _team_sync(s).results.select("seq", "club_nombre", "club_id", "error", "equipo_id", "equipo_creado")


@query(
    "sync_teams_table",
    f"""SELECT id, {', '.join('e.' + c.strip() for c in _IDENTITY.split(','))}, coalesce(new_name, nombre_federacion) nombre_federacion, activo OR new_name IS NOT NULL activo
    FROM r_equipos e LEFT JOIN (SELECT * FROM {_TEAMS} WHERE NOT created) t ON t.equipo_id = e.id
    UNION ALL SELECT equipo_id, {_IDENTITY}, new_name, true FROM {_TEAMS} WHERE created""",
)
def sync_teams_table(s):
    return _team_sync(s).teams


@query(
    "sync_aliases_table",
    f"""SELECT id, club_id, alias, alias_normalizado, fuente, activo FROM r_club_aliases UNION ALL
    SELECT (SELECT max(id) FROM r_club_aliases) + row_number() OVER (ORDER BY f.seq), f.club_id, f.club_nombre, k, 'importador', true FROM (
      SELECT {key('club_nombre')} k, min({{'seq': seq, 'club_id': club_id, 'club_nombre': club_nombre}}) f FROM {_VALIDATED} WHERE error IS NULL GROUP BY 1)
    WHERE k NOT IN (SELECT alias_normalizado FROM r_club_aliases)""",
)
def sync_aliases_table(s):
    return _team_sync(s).aliases


@query(
    "payload_rows",
    "SELECT batch_id, count(*) AS rows FROM (SELECT match_key // 5 batch_id FROM r_pairings) WHERE batch_id % 53 <> 0 AND batch_id % 59 <> 0 GROUP BY 1",
)
def payload_rows(s):
    return fixture_rows(s.lotes).groupBy("batch_id").agg(F.count("*").alias("rows"))
