"""League tables, form, head-to-head, adjustments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.league_sql import SCOPE, STANDINGS_ORDER
from checks.registry import query
from tanteo.functions.numbers import goal_quotient, result_letter, result_points
from tanteo.operators import silver
from tanteo.operators import standings as ops
from tanteo.operators.ranking import ranked, top_per_group
from tanteo.operators.scope import matches_in_scope, top_division_teams, within_one_scope
from tanteo.plans import mergeable
from tanteo.plans.reports import standings_report
from tanteo.session import scratch_dir
from tanteo.sources.snapshots import SnapshotStore
from tanteo.sources.star_league import COMPETITION_ID, SEASON_ID

VIEW_SQL = """SELECT e.temporada_id, e.id equipo_id, e.club_id, c.nombre club, e.rama, e.categoria, e.division, e.equipo_codigo,
    coalesce(pj, 0) pj, coalesce(pg, 0) pg, coalesce(pe, 0) pe, coalesce(pp, 0) pp, coalesce(gf, 0) gf, coalesce(ga, 0) ga,
    coalesce(gf, 0) - coalesce(ga, 0) dif, coalesce(pg, 0) * 3 + coalesce(pe, 0) * 2 + coalesce(pp, 0) puntos
    FROM r_equipos e JOIN r_clubes c ON c.id = e.club_id LEFT JOIN (
      SELECT equipo_id, count(*) pj, count(*) FILTER (own > opp) pg, count(*) FILTER (own = opp) pe, count(*) FILTER (own < opp) pp,
      sum(own)::BIGINT gf, sum(opp)::BIGINT ga FROM (
        SELECT local_equipo_id equipo_id, goles_local own, goles_visitante opp FROM r_partidos UNION ALL
        SELECT visitante_equipo_id, goles_visitante, goles_local FROM r_partidos) WHERE own IS NOT NULL AND opp IS NOT NULL GROUP BY 1
    ) a ON a.equipo_id = e.id WHERE e.activo"""


@query("standings_view", VIEW_SQL)
def standings_view(s):
    return ops.standings_view(s.equipos, s.clubes, s.partidos)


_UNPLAYED = """(SELECT * REPLACE (CASE WHEN idle THEN NULL ELSE goles_local END AS goles_local, CASE WHEN idle THEN NULL ELSE goles_visitante END AS goles_visitante)
    FROM (SELECT *, local_equipo_id // 4 % 7 = 0 OR visitante_equipo_id // 4 % 7 = 0 idle FROM r_partidos))"""


@query("standings_left", VIEW_SQL.replace("FROM r_partidos", f"FROM {_UNPLAYED}"))
def standings_left(s):
    """Teams that have not played yet still appear, with zeros."""
    return ops.standings_view(s.equipos, s.clubes, s.partidos_sin_jugar)


@query(
    "union_all_sides",
    "SELECT match_id, team_id, opponent_id, own, opp, at_home = 1 at_home FROM s_sides",
)
def union_all_sides(s):
    return ops.match_sides(ops.finished_matches(s.scoped), "match_id")


@query(
    "team_table",
    f"""SELECT team_id, club_id, team_code, name, {SCOPE}, played, won, drawn, lost, gf, ga, gd, points,
    coalesce(q.players, 0) players, coalesce(q.goals, 0) goals, coalesce(form, '') form FROM s_results
    LEFT JOIN (SELECT team_id, count(*) players, sum(goals)::BIGINT goals FROM s_sheet GROUP BY 1) q USING (team_id)
    LEFT JOIN s_form USING (team_id)""",
)
def team_table(s):
    table = s.team_rows.withColumn("form", F.array_join("form", ""))
    return table.select(
        "team_id", "club_id", "team_code", "name", *ops.SCOPE, *ops.RESULT_COLUMNS, "players", "goals", "form"
    )


@query("team_form", "SELECT team_id, form FROM s_form")
def team_form(s):
    return ops.team_form(s.scoped).withColumn("form", F.array_join("form", ""))


@query("h2h_self_join", "SELECT match_id, home_team_id, away_team_id, home_score, away_score FROM s_h2h")
def h2h_self_join(s):
    return ops.head_to_head_matches(ops.result_table(s.cards, s.played), s.played)


@query("h2h_mini_table", "SELECT * FROM s_mini")
def h2h_mini_table(s):
    return ops.mini_table(ops.result_table(s.cards, s.played), s.played)


_STANDING = ("team_id", *ops.SCOPE, "name", "played", "gf", "ga", "gd", "points", "mini_points", "pos")


@query(
    "standings_olympic",
    f"SELECT team_id, {SCOPE}, name, played, gf, ga, gd, points, mini_points, pos FROM s_standings",
)
def standings_olympic(s):
    return s.standings.select(*_STANDING)


@query(
    "report_standings_csv",
    """SELECT pos "Posición", name "Club", played "PJ", won "PG", drawn "PE", lost "PP", gf "GF", ga "GC", gd "DIF", points "PTS"
    FROM s_standings""",
)
def report_standings(s):
    return standings_report(s.standings)


@query(
    "top_division_standings",
    """SELECT team_id, branch, name, points, row_number() OVER (PARTITION BY branch ORDER BY ORDERING) pos FROM (
    SELECT r.*, coalesce(mini_points, 0) mini_points, coalesce(mini_gf, 0) mini_gf, coalesce(mini_ga, 0) mini_ga FROM s_results r
    LEFT JOIN s_mini USING (team_id) WHERE team_id IN (SELECT team_id FROM s_top_teams))""".replace("ORDERING", STANDINGS_ORDER),
)
def top_division_standings(s):
    return _top_standings(s).select("team_id", "branch", "name", "points", "pos")


def _top_standings(s):
    cards = top_division_teams(s.cards)
    matches = matches_in_scope(s.played, cards)
    return ops.standings(ops.result_table(cards, matches), matches, by=("branch",))


@query(
    "mini_standings_top5",
    """SELECT team_id, branch, name, points, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY branch ORDER BY ORDERING) pos FROM (
    SELECT r.*, coalesce(mini_points, 0) mini_points, coalesce(mini_gf, 0) mini_gf, coalesce(mini_ga, 0) mini_ga FROM s_results r
    LEFT JOIN s_mini USING (team_id) WHERE team_id IN (SELECT team_id FROM s_top_teams))) WHERE pos <= 5""".replace(
        "ORDERING", STANDINGS_ORDER
    ),
)
def mini_standings_top5(s):
    return _top_standings(s).where("pos <= 5").select("team_id", "branch", "name", "points", "pos")


@query(
    "result_points",
    """SELECT match_id, team_id, CASE WHEN own > opp THEN 3 WHEN own = opp THEN 2 ELSE 1 END::BIGINT points,
    CASE WHEN own > opp THEN 'W' WHEN own = opp THEN 'D' ELSE 'L' END result FROM s_sides""",
)
def points_of_results(s):
    own, opp = F.col("own"), F.col("opp")
    sides = ops.match_sides(ops.finished_matches(s.scoped), "match_id")
    return sides.select(
        "match_id", "team_id", result_points(own, opp).alias("points"), result_letter(own, opp).alias("result")
    )


@query(
    "goal_quotient",
    """SELECT team_id, CASE WHEN ga = 0 THEN CASE WHEN gf > 0 THEN 'Infinity'::DOUBLE ELSE 0.0::DOUBLE END ELSE gf / ga END quotient FROM s_results""",
)
def quotient(s):
    return s.results.select("team_id", goal_quotient(F.col("gf"), F.col("ga")).alias("quotient"))


def _by_team(column: str) -> str:
    return f"SELECT team_id, name, {column}, row_number() OVER (ORDER BY {column} DESC, team_id) pos FROM s_results"


@query("club_goals_rank", _by_team("gf"))
def club_goals_rank(s):
    return ranked(s.results.select("team_id", "name", "gf"), [], [F.desc("gf"), F.asc("team_id")])


@query("club_balance_rank", _by_team("gd"))
def club_balance_rank(s):
    return ranked(s.results.select("team_id", "name", "gd"), [], [F.desc("gd"), F.asc("team_id")])


def _state(s):
    return SnapshotStore(s.spark, f"{scratch_dir(s.spark).rstrip('/')}/state-{uuid.uuid4().hex}")


@query("standings_incremental", "SELECT season_id, team_id, played, won, drawn, lost, gf, ga, points FROM s_results WHERE played > 0")
def standings_incremental(s):
    """Results kept as partial states: those from before every seventh club had played, brought up to date."""
    totals = mergeable.standings_totals(_state(s))
    before = silver.normalize_matches(s.partidos_sin_jugar, s.teams, s.clubs).withColumn("season_id", F.lit(SEASON_ID).cast("bigint"))
    for number, matches in enumerate((before, s.checked("matches"))):
        totals.apply(("standings", number), mergeable.standings_rows(within_one_scope(matches)))
    return totals.totals()


@query(
    "player_stats_incremental",
    f"""SELECT {SEASON_ID}::BIGINT season_id, player_id, team_id, matches_played, goals, two_min, yellow, red, assists, shots, saves::BIGINT saves FROM s_stats""",
)
def player_stats_incremental(s):
    """Player totals from the lines of matches up to 1996, then from all."""
    totals = mergeable.player_totals(_state(s))
    matches, lines = s.checked("matches"), s.checked("lines")
    early = lines.join(matches.where("match_date < '1997'").select("match_id"), "match_id", "left_semi")
    for number, part in enumerate((early, lines)):
        totals.apply(("players", number), mergeable.player_rows(part, matches))
    return totals.totals()


_CHECKED = f"""(SELECT *, list_filter([
    CASE WHEN competition_id IS NULL THEN 'competitionId requerido' END,
    CASE WHEN points_delta = 0 THEN 'pointsDelta entero no cero requerido' END,
    CASE WHEN reason IS NULL THEN 'reason requerido' END,
    CASE WHEN trim(official_source) = '' THEN 'officialSource requerida' END,
    CASE WHEN season_id <> {SEASON_ID} THEN 'seasonId fuera de scope' END,
    CASE WHEN competition_id IS DISTINCT FROM {COMPETITION_ID} THEN 'competitionId fuera de scope' END,
    CASE WHEN team_id >= (SELECT max(c_custkey) + 1 FROM customer) THEN 'teamId fuera de scope' END], lambda x: x IS NOT NULL) errors FROM (
    SELECT CASE WHEN c_custkey % 45 <> 0 THEN c_custkey ELSE c_custkey + (SELECT max(c_custkey) + 1 FROM customer) END team_id,
    CASE WHEN c_custkey % 63 = 0 THEN 2 ELSE {SEASON_ID} END season_id, CASE WHEN c_custkey % 81 <> 0 THEN {COMPETITION_ID} END competition_id,
    c_custkey % 7 - 3 points_delta, CASE WHEN c_custkey % 99 <> 0 THEN 'Resolución' END reason,
    CASE WHEN c_custkey % 117 = 0 THEN '  ' ELSE 'x' END official_source FROM customer))"""


@query("validate_adjustments", f"SELECT team_id, points_delta, array_to_string(errors, ',') errors FROM {_CHECKED}")
def validate_adjustments(s):
    checked = ops.validate_adjustments(s.ajustes, SEASON_ID, COMPETITION_ID, s.teams)
    return checked.select("team_id", "points_delta", "errors")


@query(
    "apply_adjustments",
    f"""SELECT team_id, points sporting_points, coalesce(delta, 0) administrative_points, points + coalesce(delta, 0) points,
    coalesce(n, 0) applied_adjustments FROM s_results LEFT JOIN (SELECT team_id, sum(points_delta)::BIGINT delta, count(*) n
    FROM {_CHECKED} WHERE len(errors) = 0 GROUP BY 1) USING (team_id)""",
)
def apply_adjustments(s):
    rows, _ = ops.apply_adjustments(s.results, s.ajustes, SEASON_ID, COMPETITION_ID)
    return rows.select("team_id", "sporting_points", "administrative_points", "points", "applied_adjustments")


@query(
    "rejected_adjustments",
    f"""SELECT team_id, array_to_string(CASE WHEN team_id >= (SELECT max(c_custkey) + 1 FROM customer)
    THEN list_append(errors, 'teamId sin fila en tabla') ELSE errors END, ',') errors FROM {_CHECKED} WHERE len(errors) > 0""",
)
def rejected_adjustments(s):
    _, rejected = ops.apply_adjustments(s.results, s.ajustes, SEASON_ID, COMPETITION_ID)
    return rejected.select("team_id", "errors")


@query(
    "limit_k",
    f"SELECT team_id, {SCOPE}, points, n pos FROM (SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY points DESC, gd DESC, team_id) n FROM s_results) WHERE n <= 18",
)
def limit_k(s):
    rows = s.results.select("team_id", *ops.SCOPE, "points", "gd")
    return top_per_group(rows, ops.SCOPE, [F.desc("points"), F.desc("gd"), F.asc("team_id")], 18).drop("gd")
