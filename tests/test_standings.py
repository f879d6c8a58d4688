"""Tie-breaks, adjustments and distributed positions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tanteo.operators import standings
from tanteo.operators.ranking import ranked, top_overall, top_per_group

TABLE = "team_id int, name string, points int, gd int, gf int, ga int"
MATCHES = "match_id int, status string, home_team_id int, away_team_id int, home_score int, away_score int"


def finished(frame, *games):
    return frame(MATCHES, *[(i, "Finalizado", *game) for i, game in enumerate(games)])


def order(table, matches):
    ranked_rows = standings.standings(table.withColumn("scope", F.lit("x")), matches, by=["scope"])
    return [r.team_id for r in ranked_rows.orderBy("pos").collect()]


def test_mini_table_beats_overall_difference(frame):
    table = frame(TABLE, (1, "A", 20, -5, 100, 105), (2, "B", 20, 0, 110, 110), (3, "C", 20, 12, 130, 118), (4, "D", 18, 50, 160, 110))
    games = finished(frame, (1, 2, 30, 20), (1, 3, 25, 24), (2, 3, 28, 27), (4, 1, 40, 10))
    assert order(table, games) == [1, 2, 3, 4]


def test_direct_match_decides_a_pair(frame):
    table = frame(TABLE, (10, "Directo", 12, -8, 70, 78), (11, "Mejor", 12, 15, 90, 75))
    assert order(table, finished(frame, (10, 11, 22, 21))) == [10, 11]


def test_without_head_to_head_the_overall_difference_decides(frame):
    table = frame(TABLE, (21, "Menor", 8, 1, 50, 49), (22, "Mayor", 8, 4, 45, 41))
    assert order(table, frame(MATCHES)) == [22, 21]


def brute_force(teams, games):
    """The rule stated row by row."""

    def points(own, opp):
        return 3 if own > opp else 2 if own == opp else 1

    def key(t):
        group = {u["team_id"] for u in teams if u["points"] == t["points"]}
        mini = [0, 0, 0]
        for home, away, hs, as_ in games:
            if {home, away} <= group and t["team_id"] in (home, away):
                own, opp = (hs, as_) if t["team_id"] == home else (as_, hs)
                mini = [mini[0] + points(own, opp), mini[1] + own, mini[2] + opp]
        return (
            -t["points"], -mini[0], -(mini[1] - mini[2]), -mini[1], mini[2], -(t["gf"] - t["ga"]), -t["gf"], t["ga"],
            t["name"], t["team_id"],
        )

    return [t["team_id"] for t in sorted(teams, key=key)]


def test_random_leagues_agree_with_the_rule(frame):
    rng = random.Random(5)
    teams = [
        {"team_id": i, "name": f"t{i:02}", "points": rng.choice([8, 9, 10]), "gf": rng.randint(20, 24), "ga": rng.randint(20, 24)}
        for i in range(24)
    ]
    games = [(*rng.sample(range(24), 2), rng.randint(18, 22), rng.randint(18, 22)) for _ in range(60)]
    table = frame(TABLE, *[(t["team_id"], t["name"], t["points"], t["gf"] - t["ga"], t["gf"], t["ga"]) for t in teams])
    assert order(table, finished(frame, *games)) == brute_force(teams, games)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_sliced_positions_equal_the_window(spark, by):
    """One group holds nine tenths of the rows, most of them tie on the first key, and the slices are not merged."""
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 10).alias("g"), (F.col("id") * 7919 % 3).alias("v")
    )
    keys = [F.desc("v"), F.asc("id")]
    window = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*keys))
    whole = {(r.id, r.pos) for r in rows.withColumn("pos", window).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        positioned = ranked(rows, by, keys)
        assert {(r.id, r.pos) for r in positioned.collect()} == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.id, r.pos) for r in ranked(rows, by, keys).collect()} == whole
    assert not ranked(rows.limit(0), by, keys).collect()


def test_sliced_positions_with_spanish_names(spark):
    from tanteo.functions.text import spanish

    rows = spark.range(300).select("id", F.concat(F.element_at(F.array(*map(F.lit, ("Á", "a", "ñ", "N"))), (F.col("id") % 4 + 1).cast("int")), F.lit("x")).alias("n"))
    keys = [spanish(F.col("n")).asc(), F.asc("id")]
    window = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys))
    whole = {(r.id, r.pos) for r in rows.withColumn("pos", window).collect()}
    assert {(r.id, r.pos) for r in ranked(rows, [], keys).collect()} == whole


def test_first_rows(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    assert [r.id for r in top_overall(rows, [F.desc("id")], 3).orderBy("pos").collect()] == [99, 98, 97]
    kept = top_per_group(rows, ["g"], [F.desc("id")], 2).collect()
    assert sorted((r.g, r.pos, r.id) for r in kept) == [(0, 1, 99), (0, 2, 96), (1, 1, 97), (1, 2, 94), (2, 1, 98), (2, 2, 95)]


ADJUSTMENT = (
    "team_id int, season_id int, competition_id int, points_delta int, reason string, official_source string, resolution_date string"
)
VALID = (1, 4, 10, -3, "Resolución disciplinaria", "https://example.invalid/r", "2026-09-12")


def test_adjustments(frame):
    table = frame("team_id int, name string, points int", (1, "A", 12), (2, "B", 10))
    rows, rejected = standings.apply_adjustments(table, frame(ADJUSTMENT, VALID, (99, *VALID[1:])), 4, 10)
    by_team = {r.team_id: r for r in rows.collect()}
    assert (by_team[1].sporting_points, by_team[1].administrative_points, by_team[1].points) == (12, -3, 9)
    assert by_team[2].points == 10
    assert [r.errors for r in rejected.collect()] == [["teamId fuera de scope", "teamId sin fila en tabla"]]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({4: None}, "reason requerido"), ({5: " "}, "officialSource requerida"), ({6: None}, "resolutionDate requerida"),
        ({3: 0}, "pointsDelta entero no cero requerido"), ({0: 99}, "teamId fuera de scope"), ({1: 3}, "seasonId fuera de scope"),
    ],
)
def test_each_reason_rejects(frame, change, reason):
    row = tuple(change.get(i, v) for i, v in enumerate(VALID))
    checked = standings.validate_adjustments(frame(ADJUSTMENT, row), 4, 10, frame("team_id int", (1,), (2,)))
    assert checked.first().errors == [reason]
