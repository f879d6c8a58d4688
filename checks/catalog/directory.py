"""Scopes, calendars, summaries, search and context resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.league_sql import norm, pick, rank_of, ratio, safe_url
from checks.registry import query
from tanteo.operators import calendar, directory, scope, search, silver
from tanteo.plans.reports import matches_report
from tanteo.sources import star_league as star
from tanteo.sources.star_league import SEASON_ID, TODAY

CATEGORY, DIVISION, BRANCH = "Mayores", "LHC Hipotecario Seguros", "M"
IN_SCOPE = f"category = '{CATEGORY}' AND division = '{DIVISION}' AND branch = '{BRANCH}'"
SCOPED_IDS = f"(SELECT team_id FROM s_cards WHERE {IN_SCOPE})"
SCOPED_MATCHES = f"(SELECT * FROM s_matches WHERE home_team_id IN {SCOPED_IDS} AND away_team_id IN {SCOPED_IDS})"
TOP_MATCHES = """(SELECT * FROM s_matches WHERE home_team_id IN (SELECT team_id FROM s_top_teams)
    AND away_team_id IN (SELECT team_id FROM s_top_teams))"""


def _scoped(s):
    return scope.scope_teams(s.cards, CATEGORY, DIVISION, BRANCH)


@query("scope_teams", f"SELECT team_id, team_code FROM s_cards WHERE {IN_SCOPE}")
def scope_teams(s):
    return scope.scope_teams(s.teams, CATEGORY, DIVISION, BRANCH).select("team_id", "team_code")


@query("matches_in_scope", f"SELECT match_id, home_team_id, away_team_id FROM {SCOPED_MATCHES}")
def matches_in_scope(s):
    return scope.matches_in_scope(s.matches, _scoped(s)).select("match_id", "home_team_id", "away_team_id")


@query("top_division_teams", "SELECT team_id, branch, division FROM s_top_teams")
def top_division_teams(s):
    return scope.top_division_teams(s.teams).select("team_id", "branch", "division")


@query(
    "top_division_fallback",
    """SELECT team_id, branch, CASE branch WHEN 'F' THEN 'Liga de Honor B' ELSE division END division FROM s_top_teams""",
)
def top_division_fallback(s):
    """Without any top-division women's team, the women's other honour divisions stand in."""
    teams = silver.normalize_teams(s.equipos_sin_lhd, s.clubs, SEASON_ID)
    return scope.top_division_teams(teams).select("team_id", "branch", "division")


@query(
    "top_division_matches",
    f"SELECT match_id, status FROM {TOP_MATCHES}",
)
def top_division_matches(s):
    return scope.matches_in_scope(s.matches, scope.top_division_teams(s.teams)).select("match_id", "status")


@query("active_teams", "SELECT team_id FROM s_cards WHERE active")
def active_teams(s):
    return scope.active_teams(s.teams).select("team_id")


@query(
    "club_search",
    f"SELECT team_id, name, points, gd, gf FROM s_results WHERE contains({norm('name')}, 'atletico 1')",
)
def club_search(s):
    return directory.search_clubs(s.results, "Atlético 1").select("team_id", "name", "points", "gd", "gf")


@query(
    "match_list",
    """SELECT match_id, match_date, match_time, home_name, away_name FROM s_matches
    WHERE status = 'Programado' AND (home_club_id % 5 = 1 AND home_club_id = 1 OR away_club_id = 1)""",
)
def match_list(s):
    found = calendar.match_list(s.matches, "Programado", club_id=1, newest_first=False)
    return found.select("match_id", "match_date", "match_time", "home_name", "away_name")


@query(
    "report_matches_csv",
    """SELECT match_date "Fecha", match_time "Hora", round_label "Jornada", home_name "Local", away_name "Visitante", status "Estado",
    home_score "Goles local", away_score "Goles visitante" FROM s_matches""",
)
def report_matches(s):
    return matches_report(s.matches)


@query(
    "last_results",
    f"""SELECT match_id, match_date, home_score, away_score, row_number() OVER (ORDER BY match_date || match_time DESC, match_id DESC) pos
    FROM {TOP_MATCHES} WHERE status = 'Finalizado' QUALIFY pos <= 3""",
)
def last_results(s):
    matches = scope.matches_in_scope(s.matches, scope.top_division_teams(s.teams))
    return calendar.last_results(matches).select("match_id", "match_date", "home_score", "away_score", "pos")


@query(
    "upcoming",
    f"""SELECT match_id, match_date, match_time, row_number() OVER (ORDER BY match_date || match_time, match_id) pos
    FROM {TOP_MATCHES} WHERE status <> 'Finalizado' AND match_date >= '{TODAY}' QUALIFY pos <= 4""",
)
def upcoming(s):
    matches = scope.matches_in_scope(s.matches, scope.top_division_teams(s.teams))
    return calendar.upcoming(matches, TODAY).select("match_id", "match_date", "match_time", "pos")


_EACH_SIDE = "(SELECT *, home_team_id team_id FROM s_matches UNION ALL SELECT *, away_team_id FROM s_matches)"


@query(
    "next_match",
    f"""SELECT team_id, match_id, match_date FROM {_EACH_SIDE} WHERE status <> 'Finalizado' AND match_date >= '{TODAY}'
    QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY match_date || match_time, match_id) = 1""",
)
def next_match(s):
    return calendar.next_match(s.matches, TODAY).select("team_id", "match_id", "match_date")


@query(
    "club_coverage",
    f"""SELECT team_id, coalesce(matches, 0) matches, coalesce(with_fixture, 0) with_fixture, coalesce(with_sheet, 0) with_sheet,
    coalesce(players, 0) players FROM s_cards LEFT JOIN (SELECT team_id, count(*) matches, count({safe_url('fixture_url')}) with_fixture,
    count({safe_url('sheet_url')}) with_sheet FROM {_EACH_SIDE} GROUP BY 1) USING (team_id)
    LEFT JOIN (SELECT team_id, count(*) players FROM s_rosters GROUP BY 1) USING (team_id)""",
)
def club_coverage(s):
    return calendar.club_coverage(s.matches, s.rosters, s.teams)


@query(
    "entity_lookup",
    f"SELECT match_id, home_name, away_name FROM {SCOPED_MATCHES} WHERE match_id IN (1, 2, 3, 10, 20, 40, 80, 160)",
)
def entity_lookup(s):
    matches = scope.matches_in_scope(s.matches, _scoped(s))
    found = directory.entity_lookup(matches, "match_id", [1, 2, 3, 10, 20, 40, 80, 160])
    return found.select("match_id", "home_name", "away_name")


_SUMMARY = f"""count(*) matches, count(*) FILTER (status = 'Finalizado') finished,
    coalesce(sum(coalesce(home_score, 0) + coalesce(away_score, 0)) FILTER (status = 'Finalizado'), 0)::BIGINT goals"""


@query(
    "scope_summary",
    f"""SELECT *, {ratio('goals', 'finished')} avg_goals FROM (SELECT (SELECT count(*) FROM s_cards WHERE {IN_SCOPE}) clubs,
    (SELECT count(*) FROM s_rosters WHERE team_id IN {SCOPED_IDS}) players, {_SUMMARY} FROM {SCOPED_MATCHES})""",
)
def scope_summary(s):
    return directory.scope_summary(_scoped(s), s.rosters, s.matches)


_GLOBAL = f"""SELECT *, {ratio('goals', 'finished')} avg_goals FROM (SELECT (SELECT count(*) FROM r_clubes) clubs,
    (SELECT count(*) FROM r_jugadores) players, {_SUMMARY} FROM s_matches)"""


@query("global_summary", _GLOBAL)
def global_summary(s):
    return directory.global_summary(s.clubes, s.jugadores, s.partidos)


@query("dashboard_health", f"SELECT matches, finished, greatest(0, matches - finished) scheduled FROM ({_GLOBAL})")
def dashboard_health(s):
    return directory.dashboard_health(directory.global_summary(s.clubes, s.jugadores, s.partidos))


_PER_COMPETITION = f"""SELECT branch, category, division, teams, coalesce(matches, 0) matches, coalesce(finished, 0) finished,
    1::BIGINT competitions, {rank_of('category')} AS rank FROM (SELECT branch, category, division, scope, count(*) teams FROM s_cards WHERE active GROUP BY ALL)
    LEFT JOIN (SELECT home_scope scope, count(*) matches, count(*) FILTER (status = 'Finalizado') finished FROM s_matches
      WHERE home_scope = away_scope AND home_team_id IN (SELECT team_id FROM s_cards WHERE active)
      AND away_team_id IN (SELECT team_id FROM s_cards WHERE active) GROUP BY 1) USING (scope)"""


@query(
    "competition_directory",
    f"""WITH per AS ({_PER_COMPETITION}) SELECT * FROM per UNION ALL SELECT NULL, NULL, NULL, sum(teams)::BIGINT, sum(matches)::BIGINT,
    sum(finished)::BIGINT, count(*), NULL FROM per""",
)
def competition_directory(s):
    return directory.competition_directory(s.teams, s.matches).orderBy(*directory.directory_order())


@query(
    "competition_bar",
    f"""SELECT (SELECT count(*) FROM s_cards WHERE {IN_SCOPE}) teams, count(*) matches, count(*) FILTER (status = 'Finalizado') finished
    FROM {SCOPED_MATCHES}""",
)
def competition_bar(s):
    return directory.competition_bar(_scoped(s), s.matches)


@query(
    "competition_options",
    f"""SELECT 'rama' AS level, branch AS value, 0::BIGINT AS rank, branch = 'F' selected FROM s_cards GROUP BY branch UNION ALL
    SELECT 'categoria', category, {rank_of('category')}, category = 'Mayores' FROM s_cards WHERE branch = 'F' GROUP BY category UNION ALL
    SELECT 'division', division, 0, division = 'LHD Hipotecario Seguros' FROM s_cards WHERE branch = 'F' AND category = 'Mayores' GROUP BY division""",
)
def competition_options(s):
    """The requested branch exists, the category falls back to the default, the division to the first in order."""
    columns = "request_id int, rama string, categoria string, division string"
    request = s.spark.createDataFrame([(1, "F", "Veteranos", None)], columns)
    tree = scope.competition_tree(s.teams)
    return scope.competition_options(tree, scope.resolve_competitions(tree, request, _DEFAULTS)).drop("request_id")


_DEFAULTS = {"rama": BRANCH, "categoria": CATEGORY, "division": DIVISION}
# A request per customer: a branch, category and division of its own numbers, so that some do not go together or do not exist.
_COMPETITION_REQUESTS = f"""(SELECT c_custkey request_id, CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'X' WHEN 3 THEN '' END rama,
    {pick(star.CATEGORIES, 'c_custkey // 3')} categoria, {pick(star.DIVISIONS, 'c_custkey // 7')} division FROM customer)"""


@query(
    "competition_requests",
    f"""WITH b AS (SELECT request_id, CASE WHEN rama IN (SELECT branch FROM s_cards) THEN rama ELSE '{BRANCH}' END rama, categoria, division FROM {_COMPETITION_REQUESTS}),
    c AS (SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM s_cards WHERE branch = rama AND category = categoria) THEN categoria ELSE '{CATEGORY}' END AS categoria) FROM b)
    SELECT request_id, rama, categoria, CASE WHEN EXISTS (SELECT 1 FROM s_cards x WHERE branch = rama AND category = categoria AND x.division = c.division) THEN division
    WHEN EXISTS (SELECT 1 FROM s_cards x WHERE branch = rama AND category = categoria AND x.division = '{DIVISION}') THEN '{DIVISION}'
    ELSE (SELECT arg_min(x.division, {norm('x.division')}) FROM s_cards x WHERE branch = rama AND category = categoria) END division FROM c""",
)
def competition_requests(s):
    """As many requests as there are customers, in one plan."""
    requests = s.table("customer").selectExpr(
        "c_custkey AS request_id", "CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'X' WHEN 3 THEN '' END AS rama",
        f"{star.pick(star.CATEGORIES, 'c_custkey div 3')} AS categoria", f"{star.pick(star.DIVISIONS, 'c_custkey div 7')} AS division",
    )
    return scope.resolve_competitions(scope.competition_tree(s.teams), requests, _DEFAULTS)


@query(
    "bar_share",
    "SELECT team_id, gf, (200 * gf + best) // (2 * best) bar FROM s_results, (SELECT greatest(1, max(gf)) best FROM s_results)",
)
def bar_share(s):
    return directory.bar_share(s.results).select("team_id", "gf", "bar")


@query(
    "team_switcher_order",
    f"""SELECT club_id, team_id, team_code, row_number() OVER (PARTITION BY club_id ORDER BY branch, {rank_of('category')}, {norm('division')},
    team_code, team_id) pos FROM s_cards WHERE active""",
)
def team_switcher_order(s):
    return directory.team_switcher(s.teams).select("club_id", "team_id", "team_code", "pos")


_FOUND = f"""SELECT term, type, id, team_id, name, context, rank::BIGINT AS rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY term
    ORDER BY rank, {norm('name')}, type, id, team_id NULLS FIRST) pos FROM (
      SELECT *, CASE WHEN normalized = term THEN 0 WHEN starts_with(normalized, term) THEN 1 ELSE 2 END AS rank
      FROM s_index, (SELECT DISTINCT {norm('term')} AS term FROM TERMS) WHERE term <> '' AND contains(normalized, term))) WHERE pos <= 12"""
_TERMS = ("atlético 12 norte", "perez 77", "union", "Norte · Juniors", "sin resultado posible")
_TERM_LIST = "(SELECT unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + "]) AS term)"
# A term per customer: names whole and in part, contexts, one and two letters, and some that nothing has.
_CUSTOMER_TERMS = """(SELECT CASE c_custkey % 6 WHEN 0 THEN 'PÉREZ ' || c_custkey WHEN 1 THEN 'rez ' || (c_custkey * 7 % 1000) || ' ' WHEN 2 THEN ' ' || (c_custkey // 4) || ' Norte'
    WHEN 3 THEN substr(c_name, c_custkey % 9 + 1, 4) WHEN 4 THEN substr('abcdefghijklmnopqrstuvwxyz', c_custkey % 25 + 1, c_custkey % 2 + 1)
    ELSE 'Norte · Juniors · ' || c_custkey END AS term FROM customer)"""
_ANSWER = ("term", "type", "id", "team_id", "name", "context", "rank", "pos")


@query("top_k_search", _FOUND.replace("TERMS", _TERM_LIST))
def top_k_search(s):
    terms = s.spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return search.search(s.indexed, terms).select(*_ANSWER)


@query("top_k_search_terms", _FOUND.replace("TERMS", _CUSTOMER_TERMS))
def top_k_search_terms(s):
    """As many terms as there are customers."""
    terms = s.table("customer").selectExpr(
        "CASE c_custkey % 6 WHEN 0 THEN concat('PÉREZ ', c_custkey) WHEN 1 THEN concat('rez ', c_custkey * 7 % 1000, ' ') "
        "WHEN 2 THEN concat(' ', c_custkey div 4, ' Norte') WHEN 3 THEN substr(c_name, c_custkey % 9 + 1, 4) "
        "WHEN 4 THEN substr('abcdefghijklmnopqrstuvwxyz', c_custkey % 25 + 1, c_custkey % 2 + 1) "
        "ELSE concat('Norte · Juniors · ', c_custkey) END AS term"
    )
    return search.search(s.indexed, terms).select(*_ANSWER)


# Requests derived from the events: a player, sometimes a team, the top division being what is on screen.
_PLAYER_REQUESTS = """(SELECT event_id request_id, nullif(user_id % (SELECT max(p_partkey) + 1 FROM part), 0) player_id,
    CASE WHEN event_id % 3 = 0 THEN event_id % 150 END requested_team_id FROM events)"""
_MEMBERSHIPS = """(SELECT player_id, count(*) total, count(*) FILTER (v) shown, min(team_id) only_team, min(team_id) FILTER (v) only_shown
    FROM (SELECT DISTINCT player_id, team_id, team_id IN (SELECT team_id FROM s_top_teams) v FROM s_rosters WHERE player_id > 0 AND team_id > 0) GROUP BY 1)"""
_DECIDED = f"""(SELECT request_id, q.player_id, requested_team_id, shown, CASE WHEN q.player_id IS NULL THEN 'missing'
    WHEN nullif(requested_team_id, 0) IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM s_rosters r WHERE r.player_id = q.player_id
      AND r.team_id = requested_team_id) THEN 'team' ELSE 'invalid-team' END
    WHEN shown = 1 THEN 'current' WHEN shown > 1 THEN 'ambiguous' WHEN total = 1 THEN 'team' WHEN total > 1 THEN 'ambiguous' ELSE 'missing' END status,
    only_team, only_shown FROM {_PLAYER_REQUESTS} q LEFT JOIN {_MEMBERSHIPS} m ON m.player_id = q.player_id)"""


def _player_requests(s):
    requests = s.table("events").selectExpr(
        "event_id AS request_id", f"user_id % {s.player_count} AS player_id",
        "if(event_id % 3 = 0, event_id % 150, NULL) AS requested_team_id",
    )
    visible = s.rosters.join(scope.top_division_teams(s.teams).select("team_id"), "team_id", "left_semi")
    return directory.resolve_player_context(requests, s.rosters, visible)


@query(
    "resolve_player_context",
    f"""SELECT request_id, player_id, status, CASE status WHEN 'current' THEN only_shown WHEN 'team' THEN
    coalesce(nullif(requested_team_id, 0), only_team) END team_id FROM {_DECIDED}""",
)
def resolve_player_context(s):
    return _player_requests(s).decisions.drop("choice_set")


@query(
    "resolve_player_choices",
    f"""SELECT DISTINCT request_id, d.player_id, r.team_id FROM {_DECIDED} d JOIN s_rosters r ON r.player_id = d.player_id AND r.team_id > 0
    WHERE status = 'ambiguous' AND (shown = 0 OR r.team_id IN (SELECT team_id FROM s_top_teams))""",
)
def resolve_player_choices(s):
    return directory.choices(_player_requests(s))


_CONTEXTS = """(SELECT club_id entity_id, team_id, category || '|' || division || '|' || branch context_key FROM s_cards WHERE team_id > 0)"""
_CLUB_REQUESTS = """(SELECT event_id request_id, nullif(user_id % 400, 0) entity_id, CASE WHEN event_id % 4 = 1 THEN nullif(user_id % 400 * 4 + event_id % 6, 0) END
    requested_team_id, event_id % 5 = 0 current_present FROM events)"""
_CLUB_DECIDED = f"""(SELECT q.*, m.contexts, m.first_team, m.first_key, o.context_key own, CASE WHEN q.entity_id IS NULL THEN 'invalid'
    WHEN m.contexts IS NULL THEN 'missing' WHEN requested_team_id IS NOT NULL THEN CASE WHEN o.team_id IS NULL THEN 'invalid-team' ELSE 'team' END
    WHEN current_present THEN 'current' WHEN m.contexts = 1 THEN 'team' ELSE 'ambiguous' END status FROM {_CLUB_REQUESTS} q
    LEFT JOIN (SELECT entity_id, count(DISTINCT context_key) contexts, min(team_id) first_team, arg_min(context_key, team_id) first_key
      FROM {_CONTEXTS} GROUP BY 1) m ON m.entity_id = q.entity_id
    LEFT JOIN {_CONTEXTS} o ON o.entity_id = q.entity_id AND o.team_id = requested_team_id)"""


def _club_requests(s):
    requests = s.table("events").selectExpr(
        "event_id AS request_id", "user_id % 400 AS entity_id",
        "if(event_id % 4 = 1, user_id % 400 * 4 + event_id % 6, NULL) AS requested_team_id",
        "event_id % 5 = 0 AS current_present",
    )
    memberships = s.teams.select(
        F.col("club_id").alias("entity_id"), "team_id", directory.context_key().alias("context_key"),
        F.col("team_id").alias("seq"),
    )
    return directory.resolve_scoped_context(requests, memberships)


@query(
    "resolve_scoped_context",
    f"""SELECT request_id, entity_id, status, CASE WHEN status = 'invalid-team' THEN requested_team_id WHEN status = 'team' THEN
    coalesce(requested_team_id, first_team) END team_id, CASE WHEN status = 'team' THEN
    CASE WHEN requested_team_id IS NULL THEN first_key ELSE own END END context_key FROM {_CLUB_DECIDED}""",
)
def resolve_scoped_context(s):
    return _club_requests(s).decisions.drop("choice_set")


@query(
    "resolve_scoped_choices",
    f"""SELECT request_id, d.entity_id, min(c.team_id) team_id, context_key FROM {_CLUB_DECIDED} d JOIN {_CONTEXTS} c ON c.entity_id = d.entity_id
    WHERE status = 'ambiguous' GROUP BY request_id, d.entity_id, context_key""",
)
def resolve_scoped_choices(s):
    return directory.choices(_club_requests(s))
