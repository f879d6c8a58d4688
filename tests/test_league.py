"""End to end over the small league: survivors, names, statistics, standings."""

from __future__ import annotations

import pytest

from tanteo.operators import directory, players, scope, search, silver, standings
from tanteo.sources import tables
from tanteo.sources.snapshots import SnapshotStore
from tests.league import raw_tables


class League:
    def __init__(self, raw):
        self.clubs = silver.normalize_clubs(raw["clubes"])
        self.teams = silver.normalize_teams(raw["equipos"], self.clubs, 8)
        self.cards = silver.team_cards(self.teams, self.clubs)
        self.players = silver.normalize_players(raw["jugadores"])
        self.rosters = silver.normalize_rosters(raw["planteles"], self.players, self.teams)
        self.matches = silver.normalize_matches(raw["partidos"], self.teams, self.clubs)
        self.lines = silver.normalize_participations(raw["participaciones"], self.players, self.teams, self.matches)
        self.stats = players.player_team_stats(self.lines)
        self.sheet = players.player_sheet(self.rosters, self.players, self.cards, self.stats)
        self.table = standings.team_table(self.cards, self.matches, self.rosters, self.stats)


@pytest.fixture(scope="module")
def league(spark):
    return League(raw_tables(lambda schema, *rows: spark.createDataFrame(list(rows), schema)))


def ids(df, column):
    return sorted(row[0] for row in df.select(column).collect())


def test_only_sound_rows_survive(league):
    assert ids(league.teams, "team_id") == [41, 42, 43]
    assert ids(league.rosters, "roster_id") == [1, 2, 3, 4]
    assert ids(league.matches, "match_id") == [501, 502, 503]
    assert ids(league.lines, "line_id") == [1, 2, 3, 4]


def test_names_and_statuses(league):
    match = {r.match_id: r for r in league.matches.collect()}
    assert match[503].away_name == "Molino Azul · Equipo C"
    assert (match[502].status, match[502].home_score) == ("Programado", None)
    assert (match[501].round_label, match[501].match_time) == ("Fecha 3", "16:30")
    clubs = {r.club_id: r for r in league.clubs.collect()}
    assert (clubs[6].abbr, clubs[7].abbr, clubs[7].city, clubs[7].logo_url) == ("MOA", "CL", "", None)


def test_player_lines_stay_with_their_team(league):
    rows = {(r.player_id, r.team_id): r for r in league.sheet.collect()}
    assert len(rows) == 4
    a, c = rows[71, 41], rows[71, 43]
    assert (a.shirt, a.goals, a.matches_played, a.sanctions) == (5, 9, 1, 2)
    assert (c.shirt, c.goals, c.matches_played) == (15, 3, 1)
    assert a.assists is None and a.efficiency is None


def test_team_table(league):
    rows = {r.team_id: r for r in league.table.collect()}
    c = rows[43]
    assert (c.name, c.players, c.goals, c.points) == ("Molino Azul · Equipo C", 2, 5, 3)
    assert (rows[42].points, rows[42].gd, rows[42].form) == (2, -7, ["L", "L"])


def test_standings(league):
    rows = standings.standings(league.table, league.matches).orderBy("pos").collect()
    assert [(r.team_id, r.points, r.gd) for r in rows] == [(43, 3, 4), (41, 3, 3), (42, 2, -7)]


def test_points_add_up(league):
    """Every finished match shares four points and both goals."""
    total = standings.result_table(league.cards, league.matches).groupBy().sum("points", "gd", "played").first()
    assert tuple(total) == (8, 0, 4)


def test_summaries(spark, league):
    summary = directory.scope_summary(league.teams, league.rosters, league.matches).first()
    assert (summary.clubs, summary.players, summary.matches, summary.finished, summary.goals, summary.avg_goals) == (
        3, 4, 3, 2, 97, 48.5,
    )
    raw = raw_tables(lambda schema, *rows: spark.createDataFrame(list(rows), schema), dirty=False)
    whole = directory.global_summary(raw["clubes"], raw["jugadores"], raw["partidos"]).first()
    assert (whole.clubs, whole.players, whole.matches, whole.finished, whole.goals) == (2, 3, 3, 2, 97)


def test_season_dataset_keeps_what_hangs_on_sound_teams(frame):
    raw = raw_tables(frame)
    season = tables.season_dataset(raw, 8)
    assert ids(season["equipos"], "id") == ["41", "42", "43"]
    assert ids(season["partidos"], "id") == [501, 502, 503]
    assert {r.equipo_id for r in season["planteles"].collect()} == {"41", "42", "43"}
    with pytest.raises(ValueError):
        tables.season_dataset(raw, 0)


def test_match_scope_and_its_lines(frame):
    matches = frame(
        "match_id int, home_team_id int, away_team_id int", (1, 4, 9), (2, 7, 8), (3, 9, 8), (4, 9, 4), (5, 7, 4), (6, 4, None),
    )
    kept = scope.matches_in_scope(matches, frame("team_id int", (4,), (9,)))
    assert ids(kept, "match_id") == [1, 4]
    assert scope.matches_in_scope(matches, frame("team_id int")).count() == 0
    lines = frame(
        "id int, match_id int, team_id int", (1, 5, 4), (2, 4, 9), (3, 77, 4), (4, None, 4), (5, 4, 8), (6, 1, 4), (7, 1, None),
    )
    assert ids(silver.participations_in_matches(lines, kept), "id") == [2, 6]


def test_search(league, spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/index")
    search.build(store, directory.search_index(league.clubs, league.players, league.rosters, league.cards), buckets=2)
    terms = spark.createDataFrame([("molino azul",), ("QUILLFEDER",), ("Quillféder ",)], "term string")
    found = search.search(store, terms).orderBy("term", "pos").collect()
    assert [(r.term, r.type, r.id, r.team_id, r["rank"]) for r in found] == [
        ("molino azul", "club", 6, None, 0),
        ("molino azul", "player", 73, 43, 2),
        ("molino azul", "player", 71, 41, 2),
        ("molino azul", "player", 71, 43, 2),
        ("quillfeder", "player", 71, 41, 2),
        ("quillfeder", "player", 71, 43, 2),
    ]
