"""Competition choices of many requests beside walking the three levels for each."""

from __future__ import annotations

import itertools
import random

import pytest

from tanteo.operators import scope

DEFAULTS = {"rama": "M", "categoria": "Mayores", "division": "B"}


def walk(teams, asked):
    rank = {"infantil": 0, "menores": 1, "mayores": 5}
    chosen = []
    for depth, level in enumerate(("rama", "categoria", "division")):
        values = sorted(
            {t[depth] for t in teams if t[depth] and t[depth].strip()}, key=lambda v: (rank.get(v.lower(), 999) if depth == 1 else 0, v.lower(), v)
        )
        value = next((v for v in (asked[depth], DEFAULTS[level]) if v in values), values[0] if values else "")
        chosen.append(value)
        teams = [t for t in teams if not value or t[depth] == value]
    return tuple(chosen)


@pytest.mark.parametrize("seed", range(4))
def test_all_requests_resolve_as_one_by_one(spark, seed):
    source = random.Random(seed)
    branches = [["M", "F"], ["F", "X", None], [None, " "], ["F"]][seed]
    teams = [
        (source.choice(branches), source.choice(["Mayores", "Menores", "infantil", "Otra", "", None]), source.choice(["A", "B", "C", " ", None]))
        for _ in range(12)
    ]
    asked = list(itertools.product(["M", "F", "", None], ["Mayores", "infantil", "nadie", None], ["A", "C", "Z", None]))
    tree = scope.competition_tree(spark.createDataFrame(teams * 3, "branch string, category string, division string"))
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request_id int, rama string, categoria string, division string")
    resolved = scope.resolve_competitions(tree, requests, DEFAULTS)
    found = {r.request_id: (r.rama, r.categoria, r.division) for r in resolved.collect()}
    assert found == {i: walk(teams, a) for i, a in enumerate(asked)}
    selected = {}
    for r in scope.competition_options(tree, resolved).where("selected").collect():
        selected.setdefault(r.request_id, set()).add(r.value)
    assert selected == {i: {v for v in f if v} for i, f in found.items() if any(f)}


def test_no_teams_resolve_to_nothing(spark):
    tree = scope.competition_tree(spark.createDataFrame([], "branch string, category string, division string"))
    requests = spark.createDataFrame([(1, "M", None, None)], "request_id int, rama string, categoria string, division string")
    assert [tuple(r) for r in scope.resolve_competitions(tree, requests, DEFAULTS).collect()] == [(1, "", "", "")]
