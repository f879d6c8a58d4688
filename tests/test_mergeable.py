"""Totals from partial states beside totals from all rows, after every change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tanteo.operators import players, standings
from tanteo.plans import mergeable
from tanteo.sources.snapshots import SnapshotStore

SCHEMA = (
    "season_id bigint, match_id bigint, round string, home_team_id bigint, away_team_id bigint, status string, home_score bigint, away_score bigint"
)


def games(seed: int, n: int = 120):
    source = random.Random(seed)
    out = []
    for i in range(n):
        home, away = source.sample(range(1, 9), 2)
        season = source.choice([7, 8])
        done = source.random() < 0.8
        out.append((season, i, source.choice(["1", "2", "3", None]), home + 100 * season, away + 100 * season, "Finalizado" if done else "Programado",
                    source.randint(10, 30) if done else None, source.randint(10, 30) if done else None))
    return out


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/state")


def table(frame):
    return {r.team_id: tuple(r[c] for c in ("played", "won", "drawn", "lost", "gf", "ga", "points")) for r in frame.collect()}


def test_a_changed_round_costs_that_round(spark, store):
    rows = games(1)
    state = mergeable.standings_totals(store)
    apply = lambda number, part, **kw: state.apply(("s", number), mergeable.standings_rows(spark.createDataFrame(part, SCHEMA)), **kw)
    done, changed = apply(1, rows)
    assert done.applied and changed.count() == len({(r[0], r[2]) for r in rows if r[6] is not None})
    whole = lambda: table(standings.team_results(spark.createDataFrame(rows, SCHEMA)))
    assert table(state.totals()) == whole()

    # one result of one round: only that round is found changed, and the other season's files stay
    at = next(i for i, r in enumerate(rows) if r[0] == 8 and r[2] == "2" and r[6] is not None)
    rows[at] = (*rows[at][:6], rows[at][6] + 5, rows[at][7])
    before = store.manifest().tables
    _, changed = apply(2, [r for r in rows if r[0] == 8 and r[2] in ("1", "2")])
    assert [tuple(r) for r in changed.collect()] == [(8, "2")]
    after = store.manifest().tables
    assert after["standings_state@7"] == before["standings_state@7"] and after["standings_state@8"] != before["standings_state@8"]
    assert table(state.totals()) == whole()

    # the same rows again, in another order: nothing changed; a repeated run is not even looked at
    _, changed = apply(3, rows[::-1])
    assert changed.count() == 0 and table(state.totals()) == whole()
    assert not apply(3, games(5))[0].applied and table(state.totals()) == whole()

    # a round that lost all its rows
    rows = [r for r in rows if (r[0], r[2]) != (7, "3")]
    gone = spark.createDataFrame([(7, "3")], "season_id bigint, slice string")
    apply(4, [r for r in rows if r[0] == 7], emptied=gone)
    assert table(state.totals()) == whole()
    assert set(table(state.totals(8))) == {t for t in whole() if t > 800}


def test_the_rest_of_the_matches_is_not_read(spark, store, tmp_path):
    path = str(tmp_path / "matches")
    mergeable.slices(spark.createDataFrame(games(2), SCHEMA)).write.partitionBy("season_id", "slice").parquet(path)
    one = spark.read.parquet(path).where("season_id = 8 AND slice = '2'")
    read = mergeable.standings_rows(one.withColumn("round", F.col("slice").cast("string")))
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files and all("season_id=8/slice=2" in f for f in files)
    assert "PartitionFilters: [isnotnull(season_id" in read._jdf.queryExecution().executedPlan().toString()
    _, changed = mergeable.standings_totals(store).apply(("s", 1), read.withColumn("season_id", F.col("season_id").cast("bigint")))
    assert [tuple(r) for r in changed.collect()] == [(8, "2")]


def test_copies_of_a_row_are_a_change(spark, store):
    rows = games(3, 20)
    state = mergeable.standings_totals(store)
    state.apply(("s", 1), mergeable.standings_rows(spark.createDataFrame(rows, SCHEMA)))
    played = next(r for r in rows if r[6] is not None)
    _, changed = state.apply(("s", 2), mergeable.standings_rows(spark.createDataFrame([*rows, played, played], SCHEMA)))
    assert [tuple(r) for r in changed.collect()] == [(played[0], played[2] or "")]


def test_player_totals_equal_those_of_all_lines(spark, store):
    source = random.Random(4)
    matches = games(4, 60)
    lines = [
        (i, m[1], source.randint(1, 9), source.choice(m[3:5]), source.randint(0, 9), 0, 1, 0, source.choice([None, 2]), None, None)
        for i, m in enumerate(matches * 3)
    ]
    lines = spark.createDataFrame(lines, "line_id bigint, match_id bigint, player_id bigint, team_id bigint, goals bigint, two_min bigint, yellow bigint, red bigint, assists bigint, shots bigint, saves bigint")
    state = mergeable.player_totals(store)
    frame = spark.createDataFrame(matches, SCHEMA)
    state.apply(("p", 1), mergeable.player_rows(lines.where("match_id % 5 > 0"), frame))
    state.apply(("p", 2), mergeable.player_rows(lines, frame))
    columns = ["player_id", "team_id", "matches_played", "goals", "two_min", "yellow", "red", "assists", "shots", "saves"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(state.totals()) == rows(players.player_team_stats(lines))


def test_totals_of_a_season_add_up_in_place(spark, store, frame):
    """The stored sums lie by their first key: reading the totals moves none of them."""
    totals = mergeable.player_totals(store)
    matches = frame("match_id int, season_id bigint, round int", (10, 8, 1), (11, 8, 2))
    lines = frame(
        "player_id bigint, team_id bigint, match_id int, goals int, two_min int, yellow int, red int, assists int, shots int, saves int",
        (1, 4, 10, 3, 0, 0, 0, None, None, None), (1, 4, 11, 2, 0, 0, 0, 1, None, None), (2, 4, 11, 5, 0, 0, 0, None, None, None),
    )
    totals.apply(("players", 1), mergeable.player_rows(lines.where("match_id = 10"), matches))
    totals.apply(("players", 2), mergeable.player_rows(lines, matches))
    found = totals.totals()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.player_id, r.matches_played, r.goals, r.assists) for r in found.collect()) == [(1, 2, 5, 1), (2, 1, 5, None)]
