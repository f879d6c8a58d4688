"""Player statistics, leaderboards, line-ups and logs."""

from __future__ import annotations

from checks.league_sql import norm
from checks.registry import query
from tanteo.operators import players as ops
from tanteo.operators.scope import top_division_teams
from tanteo.plans import reports

IDENTITY = "player_id, team_id, roster_id"


@query(
    "player_team_stats",
    "SELECT player_id, team_id, matches_played, goals, two_min, yellow, red, sanctions, goals_per_match FROM s_stats",
)
def player_team_stats(s):
    return s.stats.select(
        "player_id", "team_id", "matches_played", "goals", "two_min", "yellow", "red", "sanctions", "goals_per_match"
    )


@query("optional_metrics", "SELECT player_id, team_id, assists, shots, saves, efficiency FROM s_stats")
def optional_metrics(s):
    return s.stats.select("player_id", "team_id", "assists", "shots", "saves", "efficiency")


@query(
    "roster_player_team_club",
    'SELECT roster_id, player_id, team_id, shirt, "position", player_name, club, club_name, branch, division FROM s_sheet',
)
def roster_player_team_club(s):
    return ops.roster_player_team_club(s.rosters, s.players, s.cards).select(
        "roster_id", "player_id", "team_id", "shirt", "position", "player_name", "club", "club_name", "branch", "division"
    )


@query(
    "player_search",
    f"""SELECT roster_id, player_name, club, goals, matches_played FROM s_sheet
    WHERE contains({norm("player_name || ' ' || club")}, 'jose perez 1') AND "position" = 'Lateral'""",
)
def player_search(s):
    found = ops.search_players(s.sheet, "José PÉREZ 1", position="Lateral", sort="goals")
    return found.select("roster_id", "player_name", "club", "goals", "matches_played")


@query(
    "participation_list",
    f"""SELECT roster_id, player_id, team_id, club, matches_played, goals, goals_per_match,
    row_number() OVER (ORDER BY goals DESC, matches_played DESC, {IDENTITY}) pos FROM s_sheet""",
)
def participation_list(s):
    return ops.participation_list(s.sheet).select(
        "roster_id", "player_id", "team_id", "club", "matches_played", "goals", "goals_per_match", "pos"
    )


def _board(order: str, where: str = "true") -> str:
    return f"""SELECT player_id, team_id, player_name, matches_played, goals, sanctions, row_number() OVER (ORDER BY {order}, {IDENTITY}) pos
    FROM s_sheet WHERE {where} QUALIFY pos <= 5"""


def _leaders(s, kind: str):
    return ops.leaderboard(s.sheet, kind).select(
        "player_id", "team_id", "player_name", "matches_played", "goals", "sanctions", "pos"
    )


@query("leaderboard_goals", _board("goals DESC"))
def leaderboard_goals(s):
    return _leaders(s, "goals")


@query("leaderboard_rate", _board("goals_per_match DESC, goals DESC", "matches_played > 0"))
def leaderboard_rate(s):
    return _leaders(s, "rate")


@query("leaderboard_played", _board("matches_played DESC, goals DESC"))
def leaderboard_played(s):
    return _leaders(s, "played")


@query("leaderboard_sanctions", _board("sanctions DESC, two_min DESC"))
def leaderboard_sanctions(s):
    return _leaders(s, "sanctions")


def _card(caption: str, measure: str, unit: str, where: str = "true") -> str:
    return f"""(SELECT '{caption}' card, player_id, team_id, player_name, club, coalesce({measure}, 0)::DOUBLE AS value, '{unit}' unit
    FROM top_sheet WHERE {where} ORDER BY coalesce({measure}, 0) DESC, {IDENTITY} LIMIT 1)"""


@query(
    "highlights",
    "SELECT * FROM (WITH top_sheet AS (SELECT * FROM s_sheet WHERE team_id IN (SELECT team_id FROM s_top_teams)) "
    + " UNION ALL ".join(
        [
            _card("GOLEADOR LIGA DE HONOR", "goals", "goles"),
            _card("GOLES / PARTIDO", "goals_per_match", "promedio", "matches_played > 0"),
            _card("MÁS PARTIDOS", "matches_played", "partidos"),
            _card("SANCIONES", "sanctions", "totales"),
        ]
    )
    + ")",
)
def highlights(s):
    return ops.highlights(_top_sheet(s))


def _top_sheet(s):
    cards = top_division_teams(s.cards)
    rosters = s.rosters.join(cards.select("team_id"), "team_id", "left_semi")
    return ops.player_sheet(rosters, s.players, cards, s.stats)


@query(
    "top_division_players",
    "SELECT roster_id, player_id, team_id, goals, matches_played FROM s_sheet WHERE team_id IN (SELECT team_id FROM s_top_teams)",
)
def top_division_players(s):
    return _top_sheet(s).select("roster_id", "player_id", "team_id", "goals", "matches_played")


@query(
    "club_scorers",
    f"""SELECT club_id, player_id, team_id, player_name, goals,
    row_number() OVER (PARTITION BY club_id ORDER BY goals DESC, {norm('player_name')}, {IDENTITY}) pos FROM s_sheet QUALIFY pos <= 5""",
)
def club_scorers(s):
    return ops.club_scorers(s.sheet).select("club_id", "player_id", "team_id", "player_name", "goals", "pos")


@query(
    "participation_roster",
    'SELECT line_id, match_id, player_id, team_id, player_name, number, "position", goals, two_min, yellow, red FROM s_lineup',
)
def participation_roster(s):
    return ops.participation_roster(s.lines, s.players, s.rosters)


@query(
    "match_lineup_order",
    """SELECT line_id, match_id, team_id, player_id, number, goals, row_number() OVER (PARTITION BY match_id, team_id
    ORDER BY goals DESC, coalesce(number, 999), player_id, line_id, two_min, yellow, red) pos FROM s_lineup""",
)
def match_lineup_order(s):
    lines = ops.participation_roster(s.lines, s.players, s.rosters)
    return ops.match_lineups(lines).select("line_id", "match_id", "team_id", "player_id", "number", "goals", "pos")


@query(
    "match_side_totals",
    "SELECT match_id, team_id, count(*) AS lines, sum(goals)::BIGINT goals FROM s_lines GROUP BY 1, 2",
)
def match_side_totals(s):
    return ops.match_side_totals(s.lines)


@query("player_match_log", "SELECT * FROM s_log")
def player_match_log(s):
    return ops.player_match_log(s.lines, s.matches)


@query(
    "recent_matches",
    """SELECT player_id, team_id, match_id, goals, recency, (200 * goals + best) // (2 * best) bar FROM (
    SELECT *, greatest(1, max(goals) OVER (PARTITION BY player_id, team_id)) best FROM (
      SELECT *, row_number() OVER (PARTITION BY player_id, team_id ORDER BY match_date DESC, match_time DESC, match_id DESC) recency
      FROM s_log QUALIFY recency <= 8))""",
)
def recent_matches(s):
    log = ops.player_match_log(s.lines, s.matches)
    return ops.recent_matches(log).select("player_id", "team_id", "match_id", "goals", "recency", "bar")


@query(
    "roster_by_position",
    """SELECT team_id, "position", roster_id, player_name, shirt, coalesce(shirt, 999) shirt_order,
    list_position(['Arquero', 'Extremo', 'Lateral', 'Central', 'Pivote', 'Sin posición'], "position")::BIGINT position_order,
    count(*) OVER (PARTITION BY team_id, "position") players FROM s_sheet""",
)
def roster_by_position(s):
    people = ops.roster_player_team_club(s.rosters, s.players, s.cards)
    return ops.roster_by_position(people).drop("player_id")


@query(
    "report_players_csv",
    """SELECT player_name "Jugador", club "Club", shirt "Dorsal", "position" AS "Posición", matches_played "Partidos", goals "Goles",
    goals_per_match "Goles/Partido", two_min "2min", yellow "Amarillas", red "Rojas" FROM s_sheet""",
)
def report_players(s):
    return reports.players_report(s.sheet)


@query(
    "report_stats_csv",
    """SELECT player_name "Jugador", club "Club", matches_played "Partidos", goals "Goles", goals_per_match "Goles/Partido",
    sanctions "Sanciones" FROM s_sheet""",
)
def report_stats(s):
    return reports.stats_report(s.sheet)
