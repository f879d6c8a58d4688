"""The test league and its checked tables as DuckDB common table expressions."""

from __future__ import annotations

import re

from tanteo.sources import star_league as star


def norm(x: str) -> str:
    return f"lower(trim(strip_accents(coalesce({x}, ''))))"


def key(x: str) -> str:
    return f"trim(regexp_replace({norm(x)}, '[^a-z0-9]+', ' ', 'g'))"


def letters(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[^a-z]', '', 'g')"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ((20 * ({a}) + ({b})) // (2 * ({b}))) / 10.0 END"


def safe_url(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^(?i)https?://[^@/?#]+([/?#].*)?$') THEN {x} END"


def rank_of(category: str) -> str:
    k = letters(category)
    order = "['infantil', 'menor', 'cadete', 'juvenil', 'junior', 'mayor']"
    full = "['infantiles', 'menores', 'cadetes', 'juveniles', 'juniors', 'mayores']"
    return f"coalesce(list_position({order}, {k}), list_position({full}, {k}), 1000)::BIGINT - 1"


def branch(x: str) -> str:
    return f"CASE {x} WHEN 'M' THEN 'Masculino' WHEN 'F' THEN 'Femenino' ELSE {x} END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values: tuple[str, ...], number: str) -> str:
    return f"({_list(values)})[(({number}) % {len(values)})::BIGINT + 1]"


def time_of(number: str) -> str:
    return f"CASE WHEN ({number}) % 5 <> 0 THEN {pick(star.TIMES, number)} END"


def club_name(club: str) -> str:
    word, again = pick(star.CLUB_WORDS, club), pick(star.CLUB_WORDS, f"{club} - 1")
    return (
        f"CASE WHEN ({club}) % 50 = 0 AND ({club}) > 0 THEN upper({again}) || '  ' || ({club} - 1) || '  NORTE' "
        f"ELSE {word} || ' ' || ({club}) || ' Norte' END"
    )


TEAM_COUNT = "(SELECT max(c_custkey) + 1 FROM customer)"
PLAYER_COUNT = "(SELECT max(p_partkey) + 1 FROM part)"
GOALS = "(l_quantity::INTEGER % 10)"
CODES = star.CODES
SCOPE = "season_id, branch, category, division"

_POSITION = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p in star.POSITION_OF_TYPE.items()) + " ELSE '' END"
_SEASONS = ", ".join(
    f"({r[0]}::BIGINT, '{r[1]}', {r[2]}::BIGINT, '{r[3]}', {r[4]}::BIGINT, DATE '{r[5]}', DATE '{r[6]}')" for r in star.SEASON_ROWS
)
STANDINGS_ORDER = (
    "points DESC, mini_points DESC, mini_gf - mini_ga DESC, mini_gf DESC, mini_ga, gf - ga DESC, gf DESC, ga, "
    "CASE WHEN ga = 0 THEN CASE WHEN gf > 0 THEN 1e308 ELSE 0 END ELSE gf / ga END DESC, "
    "strip_accents(lower(name)), team_id"
)


def _sides(source: str, extra: str = "") -> str:
    return (
        f"SELECT match_id, match_date, match_time, home_team_id team_id, away_team_id opponent_id, home_score own, "
        f"away_score opp, 1 at_home{extra} FROM {source} UNION ALL SELECT match_id, match_date, match_time, away_team_id, "
        f"home_team_id, away_score, home_score, 0{extra} FROM {source}"
    )


CTES = {
    "r_temporadas": f"SELECT * FROM (VALUES {_SEASONS}) t(id, nombre, anio, fase, competencia_id, fecha_inicio, fecha_fin)",
    "r_equipos": f"""SELECT c_custkey id, c_custkey // 4 club_id, {star.SEASON_ID}::BIGINT temporada_id,
        {pick(star.CATEGORIES, 'c_custkey')} categoria, {pick(star.DIVISIONS, 'c_custkey')} division,
        CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END rama, {pick(CODES, 'c_custkey')} equipo_codigo,
        'Fed ' || c_custkey nombre_federacion, c_custkey % 23 <> 0 activo FROM customer""",
    "r_clubes": f"""SELECT id, {club_name('id')} nombre, CASE WHEN id % 3 <> 0 THEN 'C' || id END abreviatura,
        CASE WHEN id % 7 <> 0 THEN 'Ciudad ' || (id % 13) END ciudad,
        nullif({pick(star.LOGOS, 'id')}, '') logo_url,
        id % 37 <> 0 activo FROM (SELECT c_custkey // 4 id FROM customer WHERE c_custkey % 4 = 0)""",
    "r_club_aliases": """SELECT *, 'oficial' fuente, id % 9 <> 0 activo FROM (
        SELECT id * 2 id, id club_id, 'Alias Norte ' || id alias, 'alias norte ' || id alias_normalizado FROM r_clubes WHERE id % 6 <> 0
        UNION ALL SELECT id * 2 + 1, id, 'CN ' || id, 'cn ' || id FROM r_clubes WHERE id % 10 = 3)""",
    "r_jugadores": f"""SELECT p_partkey id, {pick(star.FIRST_NAMES, 'p_partkey')} nombre, 'Pérez ' || p_partkey apellido,
        DATE '1965-01-01' + ((p_partkey * 37) % 14000)::INTEGER fecha_nacimiento,
        CASE WHEN p_partkey % 5 <> 0 THEN {pick(('Derecho', 'Izquierdo'), 'p_partkey')} END brazo_habil,
        CASE WHEN p_partkey % 4 <> 0 THEN (p_size + 150)::DOUBLE END altura_cm,
        CASE WHEN p_partkey % 6 <> 0 THEN (p_size + 50)::DOUBLE END peso_kg FROM part""",
    "r_pairings": f"""SELECT o_orderkey match_key, o_custkey home, (o_custkey + (o_orderkey % 7 + 1) * 10) % {TEAM_COUNT} away,
        o_orderdate::DATE odate, o_orderstatus FROM orders""",
    "r_partidos": f"""SELECT match_key id, {star.COMPETITION_ID}::BIGINT competencia_id, {star.SEASON_ID}::BIGINT temporada_id, odate fecha,
        {time_of('match_key')} hora, CASE WHEN match_key % 17 <> 0 THEN (match_key % 30 + 1)::BIGINT END jornada,
        home local_equipo_id, away visitante_equipo_id,
        CASE o_orderstatus WHEN 'F' THEN 'finalizado' WHEN 'O' THEN 'programado' END estado, goles_local, goles_visitante,
        NULL::VARCHAR observaciones, 'https://liga.example/f/' || match_key programacion_url,
        'https://liga.example/f/' || match_key || '.pdf' programacion_pdf_url,
        CASE WHEN match_key % 6 = 0 THEN 'reprogramacion' ELSE 'fecha_normal' END tipo_fuente,
        nullif({pick(star.SHEET_LINKS, 'match_key')}, '') planilla_url,
        CASE WHEN match_key % 3 = 0 THEN 'https://video.example/' || match_key END video_url
        FROM r_pairings LEFT JOIN (SELECT l_orderkey match_key,
          sum(CASE WHEN l_linenumber % 2 = 1 THEN {GOALS} ELSE 0 END)::BIGINT goles_local,
          sum(CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE {GOALS} END)::BIGINT goles_visitante FROM lineitem GROUP BY 1) USING (match_key)""",
    "r_participaciones": f"""SELECT l_orderkey * 8 + l_linenumber id, l_orderkey partido_id, l_partkey jugador_id,
        CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END equipo_id, {GOALS}::BIGINT goles,
        (l_linenumber % 3)::BIGINT exclusiones_2min, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT tarjeta_amarilla,
        (CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END)::BIGINT tarjeta_roja,
        CASE WHEN l_returnflag = 'A' THEN l_linenumber::BIGINT END asistencias,
        CASE WHEN l_returnflag <> 'N' THEN ({GOALS} + l_linenumber)::BIGINT END lanzamientos, NULL::BIGINT atajadas,
        CASE WHEN l_linenumber % 4 = 0 THEN (l_linenumber + 60)::BIGINT END dorsal_utilizado
        FROM lineitem JOIN r_pairings ON match_key = l_orderkey""",
    "r_planteles": f"""SELECT jugador_id * {TEAM_COUNT} + equipo_id id, jugador_id, equipo_id,
        CASE WHEN jugador_id % 13 <> 0 THEN (jugador_id % 99 + 1)::BIGINT END dorsal, {_POSITION} posicion
        FROM (SELECT DISTINCT jugador_id, equipo_id FROM r_participaciones) JOIN part ON p_partkey = jugador_id
        WHERE (jugador_id + equipo_id) % 11 <> 0""",
    "r_defectos": f"""SELECT id, CASE WHEN id % 127 = 0 THEN 9 ELSE competencia_id END competencia_id,
        CASE WHEN id % 131 = 0 THEN 2 WHEN id % 137 = 0 THEN 8 ELSE temporada_id END temporada_id, fecha, hora, local_equipo_id,
        CASE WHEN id % 97 = 0 THEN (visitante_equipo_id + 1) % {TEAM_COUNT} WHEN id % 193 = 0 THEN local_equipo_id
             WHEN id % 211 = 0 THEN -1 ELSE visitante_equipo_id END visitante_equipo_id, estado, goles_local,
        CASE WHEN id % 101 <> 0 THEN goles_visitante END goles_visitante,
        CASE WHEN id % 83 = 0 THEN ' ' ELSE programacion_url END programacion_url, programacion_pdf_url,
        CASE WHEN id % 89 = 0 THEN 'otro' ELSE tipo_fuente END tipo_fuente
        FROM r_partidos, generate_series(1, 2) g(n) WHERE n = 1 OR id % 307 = 0""",
    "r_facts": """SELECT p.*, l.id home_id, v.id away_id, s.id season, s.competencia_id season_competition,
        l.id IS NOT NULL AND v.id IS NOT NULL AND (l.temporada_id IS DISTINCT FROM p.temporada_id
          OR v.temporada_id IS DISTINCT FROM p.temporada_id OR l.categoria IS DISTINCT FROM v.categoria
          OR l.division IS DISTINCT FROM v.division OR l.rama IS DISTINCT FROM v.rama) cross_scope,
        l.temporada_id IS DISTINCT FROM p.temporada_id OR v.temporada_id IS DISTINCT FROM p.temporada_id other_season
        FROM r_defectos p LEFT JOIN r_equipos l ON l.id = p.local_equipo_id LEFT JOIN r_equipos v ON v.id = p.visitante_equipo_id
        LEFT JOIN r_temporadas s ON s.id = p.temporada_id""",
    "r_publicaciones": f"""SELECT l_orderkey * 8 + l_linenumber seq, strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') fecha,
        CASE l_linenumber % 3 WHEN 1 THEN '18:00' WHEN 2 THEN '20:30:00' END hora, {pick(star.CATEGORIES, 'home')} categoria,
        CASE WHEN l_orderkey % 409 = 0 THEN '' ELSE {pick(star.DIVISIONS, 'home')} END division,
        CASE WHEN home % 2 = 0 THEN 'M' ELSE 'f' END rama, 'Club ' || (home // 4) "local", 'CLUB  ' || (away // 4) visitante,
        {pick(CODES, 'home')} local_equipo_codigo, {pick(('a', 'b', 'c', 'd'), 'away')} visitante_equipo_codigo,
        CASE WHEN l_orderkey % 419 = 0 THEN 'otro' WHEN l_returnflag = 'R' THEN 'reprogramacion' ELSE 'fecha_normal' END tipo_fuente,
        CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 401 <> 0 THEN home END local_equipo_id,
        CASE WHEN l_orderkey % 2 = 0 THEN away END visitante_equipo_id
        FROM lineitem JOIN r_pairings ON match_key = l_orderkey""",
    "s_publications": f"""SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN local_equipo_id > 0 THEN 'ids|' || local_equipo_id || '|' || visitante_equipo_id
          ELSE concat_ws('|', 'scope', upper(rama), {key('categoria')}, {key('division')}, {key('"local"')}, upper(local_equipo_codigo),
            {key('visitante')}, upper(visitante_equipo_codigo)) END scope, fecha || '|' || coalesce(hora[1:5], 'sin-hora') schedule
        FROM (SELECT *, CASE WHEN division = '' THEN 'Fixture sin division'
          WHEN (coalesce(local_equipo_id, 0) > 0) <> (coalesce(visitante_equipo_id, 0) > 0) THEN 'Fixture con un solo equipo_id resuelto'
          WHEN local_equipo_id > 0 AND local_equipo_id = visitante_equipo_id THEN 'Local y visitante no pueden ser el mismo equipo'
          WHEN coalesce(local_equipo_id, 0) <= 0 AND {key('"local"')} = {key('visitante')} THEN 'Clubes local/visitante inválidos' END error
        FROM (SELECT * REPLACE (nullif(greatest(local_equipo_id, 0), 0) AS local_equipo_id, nullif(greatest(visitante_equipo_id, 0), 0) AS visitante_equipo_id)
              FROM r_publicaciones))""",
    "s_matchups": """SELECT scope, count(*) FILTER (tipo_fuente = 'fecha_normal') normals, count(*) FILTER (tipo_fuente = 'reprogramacion') moves,
        sum(versions)::BIGINT versiones_detectadas, min(first) FILTER (tipo_fuente = 'fecha_normal') normal,
        min(first) FILTER (tipo_fuente = 'reprogramacion') moved FROM (
          SELECT scope, tipo_fuente, schedule, min({'seq': seq, 'fecha': fecha, 'hora': hora}) first, count(*) versions
          FROM s_publications WHERE error IS NULL AND tipo_fuente IN ('fecha_normal', 'reprogramacion') GROUP BY 1, 2, 3) GROUP BY 1""",
    "s_clubs": """SELECT id club_id, nombre club_name,
        coalesce(abreviatura, upper(substr(string_split_regex(trim(nombre), '\\s+')[1], 1, 1) || substr(string_split_regex(trim(nombre), '\\s+')[2], 1, 1))) abbr,
        coalesce(ciudad, '') city, logo_url, activo active FROM r_clubes""",
    "s_cards": """SELECT e.id team_id, e.club_id, e.temporada_id season_id, e.categoria category, e.division, e.rama branch,
        e.equipo_codigo team_code, e.nombre_federacion federation_name, e.activo active, c.club_name,
        c.club_name || CASE WHEN e.equipo_codigo = 'A' THEN '' ELSE ' · Equipo ' || e.equipo_codigo END team_name,
        concat_ws('|', e.temporada_id, e.rama, e.categoria, e.division) scope
        FROM r_equipos e JOIN s_clubs c USING (club_id)""",
    "s_players": """SELECT id player_id, nombre first_name, apellido last_name, nombre || ' ' || apellido player_name,
        fecha_nacimiento::VARCHAR birth_date, brazo_habil dominant_arm, altura_cm height_cm, peso_kg weight_kg FROM r_jugadores""",
    "s_rosters": """SELECT id roster_id, jugador_id player_id, equipo_id team_id, dorsal shirt, coalesce(nullif(posicion, ''), 'Sin posición') AS "position"
        FROM r_planteles""",
    "s_matches": """SELECT p.id match_id, fecha::VARCHAR match_date, coalesce(hora[1:5], '') match_time, jornada::VARCHAR round,
        CASE WHEN jornada IS NULL THEN 'Partido' ELSE 'Fecha ' || jornada END round_label, local_equipo_id home_team_id,
        visitante_equipo_id away_team_id, h.club_id home_club_id, a.club_id away_club_id, h.team_code home_code, a.team_code away_code,
        h.team_name home_name, a.team_name away_name, h.scope home_scope, a.scope away_scope,
        CASE WHEN fin THEN goles_local END home_score, CASE WHEN fin THEN goles_visitante END away_score,
        CASE WHEN fin THEN 'Finalizado' ELSE 'Programado' END status, coalesce(observaciones, '') notes, planilla_url sheet_url, video_url,
        programacion_pdf_url fixture_url
        FROM (SELECT *, coalesce(estado, '') IN ('finalizado', 'final') OR (goles_local IS NOT NULL AND goles_visitante IS NOT NULL
              AND coalesce(estado, '') <> 'programado') fin FROM r_partidos) p
        JOIN s_cards h ON h.team_id = local_equipo_id JOIN s_cards a ON a.team_id = visitante_equipo_id""",
    "s_lines": """SELECT id line_id, partido_id match_id, jugador_id player_id, equipo_id team_id, goles goals, exclusiones_2min two_min,
        tarjeta_amarilla yellow, tarjeta_roja red, asistencias assists, lanzamientos shots, atajadas saves, dorsal_utilizado shirt_used
        FROM r_participaciones""",
    "s_stats": f"""SELECT *, two_min + yellow + red sanctions, {ratio('goals', 'matches_played')} goals_per_match,
        {ratio('goals * 100', 'shots')} efficiency FROM (SELECT player_id, team_id, count(DISTINCT match_id) matches_played,
          sum(goals)::BIGINT goals, sum(two_min)::BIGINT two_min, sum(yellow)::BIGINT yellow, sum(red)::BIGINT red,
          sum(assists)::BIGINT assists, sum(shots)::BIGINT shots, sum(saves)::BIGINT saves FROM s_lines GROUP BY 1, 2)""",
    "s_sheet": """SELECT roster_id, player_id, team_id, shirt, "position", first_name, last_name, player_name, birth_date, club_id, team_code, branch,
        category, division, team_name club, club_name, coalesce(matches_played, 0) matches_played, coalesce(goals, 0) goals,
        coalesce(two_min, 0) two_min, coalesce(yellow, 0) yellow, coalesce(red, 0) red, coalesce(sanctions, 0) sanctions, goals_per_match,
        assists, shots, saves, efficiency
        FROM s_rosters JOIN s_players USING (player_id) JOIN s_cards USING (team_id) LEFT JOIN s_stats USING (player_id, team_id)""",
    "s_finished": """SELECT * FROM s_matches WHERE status = 'Finalizado' AND home_score IS NOT NULL AND away_score IS NOT NULL
        AND home_scope = away_scope""",
    "s_sides": _sides("s_finished"),
    "s_results": f"""SELECT c.*, c.team_name name, coalesce(played, 0) played, coalesce(won, 0) won, coalesce(drawn, 0) drawn, coalesce(lost, 0) lost,
        coalesce(gf, 0) gf, coalesce(ga, 0) ga, coalesce(gf, 0) - coalesce(ga, 0) gd,
        coalesce(won, 0) * 3 + coalesce(drawn, 0) * 2 + coalesce(lost, 0) points
        FROM s_cards c LEFT JOIN (SELECT team_id, count(*) played, count(*) FILTER (own > opp) won, count(*) FILTER (own = opp) drawn,
          count(*) FILTER (own < opp) lost, sum(own)::BIGINT gf, sum(opp)::BIGINT ga FROM s_sides GROUP BY 1) USING (team_id)""",
    "s_h2h": """SELECT m.* FROM s_finished m JOIN s_results h ON h.team_id = home_team_id JOIN s_results a ON a.team_id = away_team_id
        WHERE h.points = a.points""",
    "s_h2h_sides": _sides("s_h2h"),
    "s_mini": """SELECT team_id, count(*) mini_played, sum(CASE WHEN own > opp THEN 3 WHEN own = opp THEN 2 ELSE 1 END)::BIGINT mini_points,
        sum(own)::BIGINT mini_gf, sum(opp)::BIGINT mini_ga FROM s_h2h_sides GROUP BY 1""",
    "s_standings": f"""SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY {STANDINGS_ORDER}) pos FROM (
        SELECT r.*, coalesce(mini_played, 0) mini_played, coalesce(mini_points, 0) mini_points, coalesce(mini_gf, 0) mini_gf,
        coalesce(mini_ga, 0) mini_ga FROM s_results r LEFT JOIN s_mini USING (team_id))""",
    "s_form": """SELECT team_id, string_agg(CASE WHEN own > opp THEN 'W' WHEN own < opp THEN 'L' ELSE 'D' END, '' ORDER BY n DESC) form FROM (
        SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_time DESC, match_id DESC, at_home DESC) n FROM s_sides)
        WHERE n <= 5 GROUP BY 1""",
    "s_log": """SELECT player_id, team_id, match_id, match_date, match_time, home_name, away_name, home_score, away_score, status,
        line.goals goals, line.two_min two_min, line.yellow yellow, line.red red FROM (
          SELECT player_id, team_id, match_id, min({'line_id': line_id, 'goals': goals, 'two_min': two_min, 'yellow': yellow, 'red': red}) line
          FROM s_lines GROUP BY 1, 2, 3) JOIN s_matches USING (match_id)""",
    "s_lineup": """SELECT l.*, player_name, coalesce(shirt_used, r.shirt) number, coalesce(r."position", '—') AS "position" FROM s_lines l
        JOIN s_players USING (player_id) LEFT JOIN s_rosters r USING (player_id, team_id)""",
    "s_top_teams": """SELECT * FROM s_cards WHERE category = 'Mayores' AND (division LIKE 'LHC %' OR division LIKE 'LHD %')""",
    "s_index": f"""SELECT 'club' AS type, club_id id, NULL::BIGINT team_id, club_name AS name, 'Club' context, {norm('club_name')} normalized FROM s_clubs
        UNION ALL SELECT 'player', player_id, team_id, player_name, coalesce(context, 'Jugador'),
          {norm("player_name || coalesce(' ' || context, '')")}
        FROM s_players LEFT JOIN (SELECT player_id, team_id, club_name || ' · ' || category || ' · ' || division || ' · ' || {branch('branch')} context
          FROM s_rosters JOIN s_cards USING (team_id)) USING (player_id)""",
}


def with_league(body: str) -> str:
    """Prefix a query with the tables it uses, directly or not."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    if not parts:
        return body
    own = body.lstrip()
    return f"WITH {parts},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {parts}\n{body}"
