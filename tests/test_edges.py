"""Inputs as users have them: float ids, odd links, blanks of all kinds, orphan lines, broken pairs."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tanteo.functions import numbers, web
from tanteo.operators import players, quality, silver
from tanteo.plans import match_sheets
from tanteo.sources import tables


def test_whole_numbers_are_ids(frame):
    texts = frame("v string", ("101.0",), (" 7 ",), ("x",), ("1.5",), ("NaN",), (None,))
    assert [r[0] for r in texts.select(numbers.to_id(F.col("v"))).collect()] == [101, 7, None, None, None, None]
    assert [r[0] for r in frame("v double", (101.0,), (1.5,), (float("inf"),)).select(numbers.to_int(F.col("v"))).collect()] == [101, None, None]


def test_links_and_bodies(frame):
    links = frame("u string", (" https://a_b.org/x y ",), ("http://a.org/50%|z",), ("https://u:p@a.org/",), ("ftp://a.org",), ("https://",), ("http://a.org:80",))
    found = [r[0] for r in links.select(web.safe_url(F.col("u"))).collect()]
    assert found == ["https://a_b.org/x%20y", "http://a.org/50%|z", None, None, None, "http://a.org:80"]
    bodies = frame("s int, b string", (200, '{"a": 1, "a": 2}'), (200, "x" * 3000 + " not found"), (200, "[1]"), (200, "null"))
    states = lambda sample: [r[0] for r in bodies.select(web.response_state(F.col("s"), F.col("b"), sample)).collect()]
    assert states(None) == ["public_json", "not_found", "public_json", "public_non_json"]
    assert states(2000) == ["public_json", "public_non_json", "public_json", "public_non_json"]


def _is_json(text):
    def refuse(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=refuse) is not None
    except ValueError:
        return False


def test_json_is_the_whole_text(spark):
    """Values, mutilated values and values side by side, beside the strict parser of the standard library."""
    source = random.Random(9)

    def value(depth):
        kind = source.randint(0, 6 if depth else 3)
        if kind < 4:
            return source.choice(['"a"', '"\\u00e9\\n"', "0", "-1.5e3", "true", "null", '""', '"]"', '"}{"'])
        parts = [value(depth - 1) for _ in range(source.randint(0, 3))]
        return f"[{', '.join(parts)}]" if kind == 4 else "{" + ",".join(f'"{source.choice("ab")}":{p}' for p in parts) + "}"

    texts = [value(3) for _ in range(150)]
    texts += [t[:i] + source.choice(["", "]", "}", ",", "'", "x", '"', " ", "\t", "1", "][", "},{"]) + t[i + source.randint(0, 1) :] for t in texts for i in [source.randint(0, len(t))]]
    texts += [a + source.choice(["", " ", ",", "\n", "],["]) + b for a, b in zip(texts[::2], texts[1::2], strict=True)]
    texts += ['{"a":1} junk}', "{}{}", "[1] x]", "1],[2", "1,2", "", " ", "null", " null ", "NaN", "[NaN]", "[Infinity]", "{'a':1}", "{a:1}", "05", '"\t"', "[1,]", "\ufeff{}"]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    found = dict(frame.select("t", web.is_json(F.col("t"))).collect())
    assert found == {t: _is_json(t) for t in found} and {True, False} == set(found.values())


def test_ids_of_any_type_meet(frame):
    rosters = frame("equipo_id string", ("1",), ("no number",), ("2.0",))
    assert tables.scan_by_ids(rosters, "equipo_id", frame("id bigint", (1,), (2,), (None,))).count() == 2


def test_a_match_that_lost_both_teams_is_listed_once(frame):
    matches = frame("id int, local_equipo_id int, visitante_equipo_id int", (1, 8, 9), (2, 1, 9), (3, 1, 1))
    assert sorted(r.id for r in quality.broken_refs(matches, frame("id int", (1,))).collect()) == [1, 2]


def test_scopes_do_not_run_into_each_other(frame):
    teams = frame("season_id int, branch string, category string, division string", (1, "a|b", "c", ""), (1, "a", "b|c", ""), (1, "a", "b|c", None))
    assert teams.select(silver.scope_key()).distinct().count() == 3


def test_blanks_of_documents_are_blanks(frame):
    text = frame("t string", ("﻿Fecha:  x　 y \n \nz",)).select(match_sheets.clean_text(F.col("t"))).first()[0]
    assert text == "Fecha: x y\nz"


def test_bars_need_no_join(frame):
    """The best of a player's newest matches comes from the window that numbers them."""
    log = frame(
        "player_id int, team_id int, match_id int, match_date string, match_time string, goals int",
        (1, 4, 10, "2025-01-01", None, 9), (1, 4, 11, "2025-01-02", None, 2), (1, 4, 12, "2025-01-03", None, 4), (2, 4, 12, "2025-01-03", None, 0),
    )
    found = players.recent_matches(log, 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.player_id, r.match_id, r.recency, r.bar) for r in found.collect()) == [(1, 11, 2, 50), (1, 12, 1, 100), (2, 12, 1, 0)]
