"""Sources, normalisation, scalar functions, joins and set operations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from checks.league_sql import branch, key, letters, norm, rank_of, ratio, safe_url
from checks.registry import query
from tanteo.functions import dates, labels, numbers, text, web
from tanteo.operators import calendar, silver
from tanteo.operators.ranking import ranked
from tanteo.operators.scope import active_teams, distinct_values, matches_in_scope
from tanteo.plans import publications
from tanteo.plans.team_sync import club_key
from tanteo.session import scratch_dir
from tanteo.sources import csv_files, tables
from tanteo.sources.payload import fixture_rows
from tanteo.sources.star_league import SEASON_ID, TODAY

# --- sources and sinks -------------------------------------------------------------------------------------------


@query("scan_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def scan_table(s):
    path = f"{s.folder}/orders.parquet"
    return tables.scan_table(s.spark, path, ["o_orderkey", "o_custkey"], {"o_orderstatus": "F"})


@query(
    "scan_by_ids",
    """SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def scan_by_ids(s):
    urgent = s.table("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tables.scan_by_ids(lines, "l_orderkey", urgent)


@query("count_exact", "SELECT count(*) AS rows FROM lineitem")
def count_exact(s):
    return tables.count_exact(s.table("lineitem"))


_SEASON_MATCHES = f"""(SELECT * FROM r_defectos WHERE temporada_id = {SEASON_ID} AND local_equipo_id IN (SELECT id FROM r_equipos)
    AND visitante_equipo_id IN (SELECT id FROM r_equipos))"""


@query(
    "season_dataset",
    f"""SELECT 'clubes' AS name, id FROM r_clubes WHERE id IN (SELECT club_id FROM r_equipos) UNION ALL SELECT 'equipos', id FROM r_equipos
    UNION ALL SELECT 'planteles', id FROM r_planteles UNION ALL SELECT 'partidos', id FROM {_SEASON_MATCHES} UNION ALL
    SELECT 'participaciones', id FROM (SELECT *, CASE WHEN id % 3 = 0 THEN equipo_id + 1 ELSE equipo_id END team FROM r_participaciones) l
    WHERE EXISTS (SELECT 1 FROM {_SEASON_MATCHES} m WHERE m.id = l.partido_id AND team IN (m.local_equipo_id, m.visitante_equipo_id))
    UNION ALL SELECT 'jugadores', id FROM r_jugadores WHERE id IN (SELECT jugador_id FROM r_planteles)""",
)
def season_dataset(s):
    """Matches of other seasons, of unknown teams, and lines of teams that did not play are among the raw rows."""
    raw = {**s.raw, "partidos": s.partidos_defectuosos, "participaciones": s.participaciones_ajenas}
    frames = [df.select(F.lit(name).alias("name"), "id") for name, df in tables.season_dataset(raw, SEASON_ID).items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(
    "season_matches",
    """SELECT id, local_equipo_id, visitante_equipo_id FROM r_defectos WHERE temporada_id = 3
    AND local_equipo_id IN (SELECT id FROM r_equipos WHERE activo) AND visitante_equipo_id IN (SELECT id FROM r_equipos WHERE activo)""",
)
def season_matches(s):
    found = tables.season_matches(s.partidos_defectuosos, SEASON_ID, s.equipos.where("activo"))
    return found.select("id", "local_equipo_id", "visitante_equipo_id")


@query(
    "csv_export_safe",
    """SELECT c_custkey::VARCHAR AS id, c_acctbal::VARCHAR AS balance,
    CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN ''' -' || c_name ELSE c_name END AS name FROM customer""",
)
def csv_export_safe(s):
    name = F.expr("concat(element_at(array('=', ' -', ''), cast(c_custkey % 3 as int) + 1), c_name)").alias("name")
    rows = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), name)
    return csv_files.safe_cells(rows)


@query(
    "csv_cell",
    """SELECT '"' || c_custkey || '"' AS id, '"' || replace(CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name || '"' WHEN c_custkey % 3 = 1
    THEN '''@"' || c_name || '"' ELSE c_name || '"' END, '"', '""') || '"' AS name FROM customer""",
)
def csv_cell(s):
    name = F.expr("""concat(element_at(array('=', '@"', ''), cast(c_custkey % 3 as int) + 1), c_name, '"')""").alias("name")
    return csv_files.quoted_cells(s.table("customer").select(F.col("c_custkey").alias("id"), name))


@query(
    "csv_files_written",
    """SELECT '"' || c_custkey || '","' || replace(CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name || '"' WHEN c_custkey % 3 = 1
    THEN '''@"' || c_name || '"' ELSE c_name || '"' END, '"', '""') || '"' AS line, 'EFBBBF' AS mark, '"id","name"' AS header FROM customer""",
)
def csv_files_written(s):
    """The files' bytes, read back: the mark, the header and the lines."""
    name = F.expr("""concat(element_at(array('=', '@"', ''), cast(c_custkey % 3 as int) + 1), c_name, '"')""").alias("name")
    path = f"{scratch_dir(s.spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    csv_files.write_csv(s.table("customer").select(F.col("c_custkey").alias("id"), name), path)
    lines = F.split(F.decode(F.expr("substring(content, 4)"), "UTF-8"), "\n")
    files = s.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    files = files.select(F.hex(F.expr("substring(content, 1, 3)")).alias("mark"), lines.alias("lines"))
    files = files.select("mark", F.get("lines", F.lit(0)).alias("header"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    return files.where("line != ''")


@query(
    "fixture_batch_ingest",
    """SELECT match_key // 5 batch_id, row_number() OVER (PARTITION BY match_key // 5 ORDER BY match_key) idx, 3::BIGINT temporada_id,
    CASE WHEN match_key % 71 = 0 THEN 9 ELSE 3 END::BIGINT competencia_id, CASE WHEN match_key % 61 = 0 THEN away ELSE home END local_equipo_id,
    away visitante_equipo_id, odate::VARCHAR fecha, CASE WHEN match_key % 83 <> 0 AND (match_key + 1) % 5 <> 0 THEN
    (['', '18:00:00', '19:30:00', '20:15:00', '21:00:00'])[(match_key + 1) % 5 + 1] END hora, match_key % 30 + 1 jornada FROM r_pairings
    WHERE match_key // 5 % 53 <> 0 AND match_key // 5 % 59 <> 0""",
)
def fixture_batch_ingest(s):
    rows = fixture_rows(s.lotes)
    return rows.select(
        "batch_id", "idx", "temporada_id", "competencia_id", "local_equipo_id", "visitante_equipo_id", "fecha", "hora",
        "jornada",
    )


# --- normalisation -----------------------------------------------------------------------------------------------


@query("normalize_clubs", "SELECT * FROM s_clubs")
def normalize_clubs(s):
    return silver.normalize_clubs(s.clubes)


@query(
    "normalize_teams",
    """SELECT team_id, club_id, season_id, category, division, branch, team_code, federation_name, active FROM s_cards
    WHERE club_id IN (SELECT club_id FROM s_clubs WHERE active)""",
)
def normalize_teams(s):
    clubs = silver.normalize_clubs(s.clubes.where("activo"))
    return silver.normalize_teams(s.equipos, clubs, SEASON_ID)


@query("normalize_players", "SELECT * FROM s_players")
def normalize_players(s):
    return s.players


@query(
    "normalize_rosters",
    """SELECT * FROM s_rosters WHERE team_id IN (SELECT team_id FROM s_cards WHERE active)
    AND player_id IN (SELECT player_id FROM s_players WHERE height_cm IS NOT NULL)""",
)
def normalize_rosters(s):
    players = s.players.where("height_cm is not null")
    return silver.normalize_rosters(s.planteles, players, active_teams(s.teams))


_MATCH_COLUMNS = (
    "match_id", "match_date", "match_time", "round", "round_label", "home_team_id", "away_team_id", "home_club_id",
    "away_club_id", "home_code", "away_code", "home_name", "away_name", "home_score", "away_score", "status", "notes",
    "sheet_url", "video_url",
)


@query("normalize_matches", f"SELECT {', '.join(_MATCH_COLUMNS)} FROM s_matches")
def normalize_matches(s):
    return s.matches.select(*_MATCH_COLUMNS)


@query(
    "match_team_club",
    """SELECT match_id, home_name, away_name, home_club_id, away_club_id FROM s_matches
    JOIN s_cards h ON h.team_id = home_team_id JOIN s_cards a ON a.team_id = away_team_id WHERE h.active AND a.active""",
)
def match_team_club(s):
    matches = silver.normalize_matches(s.partidos, active_teams(s.teams), s.clubs)
    return matches.select("match_id", "home_name", "away_name", "home_club_id", "away_club_id")


_LINES = """SELECT line_id, l.match_id, player_id, team_id, goals, two_min, yellow, red, assists, shots, saves, shirt_used FROM s_lines l
    JOIN s_matches m USING (match_id) WHERE (team_id = home_team_id OR team_id = away_team_id)
    AND home_team_id IN (SELECT team_id FROM s_cards WHERE active) AND away_team_id IN (SELECT team_id FROM s_cards WHERE active)"""


@query("normalize_participations", _LINES)
def normalize_participations(s):
    teams = active_teams(s.teams)
    matches = silver.normalize_matches(s.partidos, teams, s.clubs)
    return silver.normalize_participations(s.participaciones, s.players, teams, matches)


@query(
    "participations_in_matches",
    _LINES.replace("FROM s_lines l", "FROM (SELECT * REPLACE (CASE WHEN line_id % 3 = 0 THEN team_id + 1 ELSE team_id END AS team_id) FROM s_lines) l"),
)
def participations_in_matches(s):
    """Lines of teams that did not play do not enter even when their match is kept."""
    matches = matches_in_scope(s.matches, active_teams(s.teams))
    return silver.participations_in_matches(silver.typed_participations(s.participaciones_ajenas), matches)


@query(
    "team_code",
    "SELECT c_custkey team_id, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' ELSE 'C1' END code FROM customer",
)
def team_code(s):
    raw = F.expr("element_at(array('', ' b ', NULL, 'c1'), cast(c_custkey % 4 as int) + 1)")
    return s.table("customer").select(F.col("c_custkey").alias("team_id"), labels.team_code(raw).alias("code"))


@query(
    "team_display_name",
    """SELECT team_id, team_name AS name, club_name || CASE WHEN team_code = 'A' THEN '' ELSE ' ' || team_code END AS compact,
    CASE WHEN team_id % 2 = 0 THEN federation_name ELSE 'Equipo' END || CASE WHEN team_code = 'A' THEN '' ELSE ' · Equipo ' || team_code END orphan
    FROM s_cards""",
)
def team_display_name(s):
    club, federation, code = F.col("club_name"), F.col("federation_name"), F.col("team_code")
    orphan = labels.team_name(F.lit(None).cast("string"), F.when(F.col("team_id") % 2 == 0, federation), code)
    return s.cards.select(
        "team_id", F.col("team_name").alias("name"),
        labels.team_name(club, federation, code, compact=True).alias("compact"), orphan.alias("orphan"),
    )


@query(
    "match_status",
    """SELECT id match_id, coalesce(estado, '') IN ('finalizado', 'final') OR (goles_local IS NOT NULL AND goles_visitante IS NOT NULL
    AND coalesce(estado, '') <> 'programado') finished FROM r_defectos""",
)
def match_status(s):
    finished = labels.is_finished(F.col("estado"), F.col("goles_local"), F.col("goles_visitante"))
    return s.partidos_defectuosos.select(F.col("id").alias("match_id"), finished.alias("finished"))


@query(
    "match_freshness",
    f"""SELECT match_id, CASE WHEN status = 'Finalizado' THEN 'final' WHEN (home_score IS NULL OR away_score IS NULL)
    AND match_date < '{TODAY}' THEN 'result-pending' ELSE 'scheduled' END freshness FROM s_matches""",
)
def match_freshness(s):
    state = labels.freshness(
        F.col("status"), F.col("match_date"), F.col("home_score"), F.col("away_score"), TODAY
    )
    return s.matches.select("match_id", state.alias("freshness"))


@query(
    "coalesce_aliases",
    """SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag WHEN l_linenumber % 3 = 0 THEN l_linestatus END AS text,
    CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS number FROM lineitem""",
)
def coalesce_aliases(s):
    rows = s.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "if(l_linenumber % 2 = 0, l_returnflag, '') AS primera",
        "if(l_linenumber % 3 = 0, l_linestatus, NULL) AS segunda",
        "if(l_linenumber % 2 = 0, cast(l_quantity as string), 'x') AS tiros",
    )
    return rows.select(
        "l_orderkey", "l_linenumber", silver.field(rows, ["primera", "ausente", "segunda"]).alias("text"),
        silver.numeric_field(rows, ["lanzamientos", "tiros"]).alias("number"),
    )


_SPELLING = "(['INFANTIL', 'Menores ', 'cadete', 'Juvéniles', 'Junior', 'Mayores', 'Veteranos'])[c_custkey % 7 + 1]"


@query(
    "category_rank_label",
    f"""SELECT c_custkey id, CASE WHEN c_custkey % 7 = 6 THEN 999 ELSE {rank_of(_SPELLING)} END::BIGINT AS rank,
    (['Infantiles', 'Menores', 'Cadetes', 'Juveniles', 'Juniors', 'Mayores', 'Veteranos'])[c_custkey % 7 + 1] AS label,
    {letters(_SPELLING)} AS key FROM customer""",
)
def category_rank_label(s):
    spelled = F.expr(_SPELLING.replace("([", "element_at(array(").replace("])[", "), cast(").replace("+ 1]", "+ 1 as int))"))
    rows = s.table("customer").select(F.col("c_custkey").alias("id"), spelled.alias("category"))
    category = F.col("category")
    return rows.select(
        "id", labels.category_rank(category).alias("rank"), labels.category_label(category).alias("label"),
        F.regexp_replace(text.normalize_text(category), "[^a-z]", "").alias("key"),
    )


@query(
    "branch_label",
    f"""SELECT team_id, {branch('branch')} AS label, category || ' · ' || division || ' · ' || {branch('branch')} AS competition FROM s_cards""",
)
def branch_label(s):
    return s.teams.select(
        "team_id", labels.branch_label(F.col("branch")).alias("label"),
        labels.competition_label(F.col("category"), F.col("division"), F.col("branch")).alias("competition"),
    )


_AGE = f"""date_part('year', DATE '{TODAY}') - date_part('year', b) - CASE WHEN strftime(b, '%m%d') > strftime(DATE '{TODAY}', '%m%d') THEN 1 ELSE 0 END"""


@query(
    "player_age",
    f"""SELECT player_id, CASE WHEN {_AGE} BETWEEN 0 AND 99 THEN ({_AGE})::BIGINT END age FROM (
    SELECT player_id, CASE WHEN player_id % 10 <> 0 THEN birth_date::DATE END b FROM s_players)""",
)
def player_age(s):
    broken = F.when(F.col("player_id") % 10 == 0, "1999-02-30").otherwise(F.col("birth_date"))
    return s.players.select("player_id", dates.age_on(broken, F.lit(TODAY).cast("date")).alias("age"))


@query("local_date", "SELECT event_id, (ts - INTERVAL 3 HOUR)::DATE::VARCHAR AS day FROM events")
def local_date(s):
    return s.table("events").select("event_id", dates.local_date(F.col("ts")).alias("day"))


@query(
    "source_links",
    f"SELECT match_id, {safe_url('fixture_url')} fixture_url, {safe_url('sheet_url')} sheet_url, {safe_url('video_url')} video_url FROM s_matches",
)
def source_links(s):
    return calendar.source_links(s.matches).select("match_id", "fixture_url", "sheet_url", "video_url")


@query("safe_url", f"SELECT club_id, {safe_url('logo_url')} AS link FROM s_clubs")
def safe_links(s):
    return s.clubs.select("club_id", web.safe_url(F.col("logo_url")).alias("link"))


@query(
    "initials",
    "SELECT p_partkey id, upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) letters FROM part",
)
def initials(s):
    return s.table("part").select(F.col("p_partkey").alias("id"), text.initials(F.col("p_name")).alias("letters"))


# --- scalar functions --------------------------------------------------------------------------------------------


@query("normalize_text", f"SELECT club_id, {norm('club_name')} AS key FROM s_clubs")
def normalize_text(s):
    return s.clubs.select("club_id", text.normalize_text(F.col("club_name")).alias("key"))


@query("normalize_key", f"SELECT conv_id, turn, {key('text')} AS key FROM conversations")
def normalize_key(s):
    return s.table("conversations").select("conv_id", "turn", text.normalize_key(F.col("text")).alias("key"))


@query("club_key", f"SELECT club_id, {key('club_name')} AS key FROM s_clubs")
def club_keys(s):
    return s.clubs.select("club_id", club_key(F.col("club_name")).alias("key"))


@query(
    "to_number",
    """SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN 0.0 WHEN 2 THEN -1.5 ELSE 0.0 END AS number,
    CASE WHEN l_linenumber % 4 = 0 THEN l_partkey END AS id FROM lineitem""",
)
def to_number(s):
    rows = s.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "element_at(array(cast(l_quantity as string), 'abc', ' -1.5 ', 'Infinity'), l_linenumber % 4 + 1) AS number",
        "if(l_linenumber % 4 = 0, concat(' ', l_partkey), 'no-numérico') AS id",
    )
    return rows.select(
        "l_orderkey", "l_linenumber", numbers.to_number(F.col("number")).alias("number"),
        numbers.to_id(F.col("id")).alias("id"),
    )


@query("ratio_1dp", f"SELECT o_orderkey, {ratio('o_orderkey % 40', 'o_custkey % 20')} AS ratio FROM orders")
def ratio_1dp(s):
    value = numbers.ratio_1dp(F.col("o_orderkey") % 40, F.col("o_custkey") % 20)
    return s.table("orders").select("o_orderkey", value.alias("ratio"))


@query("hhmm", "SELECT id, coalesce(hora[1:5], '') AS time FROM r_partidos")
def hhmm(s):
    return s.partidos.select("id", dates.hhmm(F.col("hora")).alias("time"))


@query(
    "fingerprint",
    "SELECT id, md5(concat_ws('|', 'cruce', temporada_id, local_equipo_id, visitante_equipo_id, fecha, hora)) AS mark FROM r_partidos",
)
def fingerprint(s):
    parts = [F.lit("cruce"), *map(F.col, ("temporada_id", "local_equipo_id", "visitante_equipo_id", "fecha", "hora"))]
    return s.partidos.select("id", text.fingerprint(*parts).alias("mark"))


@query(
    "null_if_blank",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey::VARCHAR WHEN o_orderkey % 3 = 2 THEN 'x' END AS text,
    CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS number FROM orders""",
)
def null_if_blank(s):
    value = text.null_if_blank(F.expr("element_at(array('  ', concat(' ', o_orderkey, ' '), 'x'), cast(o_orderkey % 3 as int) + 1)"))
    rows = s.table("orders").select("o_orderkey", value.alias("text"))
    return rows.withColumn("number", F.col("text").try_cast("bigint"))


@query(
    "json_build",
    """SELECT id, '{"id":' || id || ',"fecha":"' || fecha || '","hora":' || coalesce('"' || hora || '"', 'null') || '}' AS json FROM r_partidos""",
)
def json_build(s):
    return s.partidos.select("id", text.json_record("id", "fecha", "hora").alias("json"))


# --- joins, orders, set operations -------------------------------------------------------------------------------


@query(
    "valid_ref_semi",
    """SELECT line_id, match_id, player_id FROM s_lines WHERE team_id IN (SELECT team_id FROM s_cards WHERE active)
    AND player_id IN (SELECT player_id FROM s_players WHERE weight_kg IS NOT NULL)""",
)
def valid_ref_semi(s):
    lines = silver.typed_participations(s.participaciones).select("line_id", "match_id", "player_id", "team_id")
    known = tables.scan_by_ids(lines, "team_id", active_teams(s.teams).select("team_id"))
    kept = tables.scan_by_ids(known, "player_id", s.players.where("weight_kg is not null").select("player_id"))
    return kept.drop("team_id")


@query("order_es", f"SELECT club_id, club_name AS name, row_number() OVER (ORDER BY {norm('club_name')}, club_id) pos FROM s_clubs")
def order_es(s):
    names = s.clubs.select("club_id", F.col("club_name").alias("name"))
    return ranked(names, [], [text.spanish(F.col("name")), F.asc("club_id")])


@query(
    "order_calendar",
    "SELECT match_id, match_date, match_time, row_number() OVER (ORDER BY match_date, match_time, match_id) pos FROM s_matches",
)
def order_calendar(s):
    columns = ("match_id", "match_date", "match_time")
    return ranked(s.matches.select(*columns), [], calendar.calendar_order(False))


@query(
    "distinct_values",
    "SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS value FROM lineitem WHERE l_linenumber % 3 <> 0",
)
def distinct(s):
    rows = s.table("lineitem").selectExpr("if(l_linenumber % 3 = 0, '  ', concat(l_returnflag, l_linestatus)) AS value")
    return distinct_values(rows, "value")


@query(
    "dedup_by_schedule",
    """SELECT scope, tipo_fuente, schedule, min(seq) AS seq, count(*) AS versions FROM s_publications WHERE error IS NULL AND tipo_fuente <> 'otro'
    GROUP BY 1, 2, 3""",
)
def dedup_by_schedule(s):
    rows = publications.identified(s.publicaciones).where("error is null")
    rows = publications.marked(rows.select("seq", "scope", "tipo_fuente", "schedule"), ["seq"])
    found = publications.distinct_schedules(rows, "scope", "tipo_fuente", "schedule")
    return found.select("scope", "tipo_fuente", "schedule", "seq", "versions")
