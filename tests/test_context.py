"""Which team a player or club request means."""

from __future__ import annotations

from tanteo.operators import directory


def test_player_requests(frame):
    memberships = frame("player_id int, team_id int", (10, 101), (20, 101), (20, 202), (20, 202), (30, 101), (30, 202), (30, 303))
    visible = frame("player_id int, team_id int", (10, 101), (30, 101), (30, 202), (40, 101))
    requests = frame(
        "request_id int, player_id string, requested_team_id int",
        (1, "10", None), (2, "20", None), (3, "20", 202), (4, "20", 999), (5, "30", None), (6, "999", None), (7, "x", None),
        (8, "0", None),
    )
    context = directory.resolve_player_context(requests, memberships, visible)
    decided, choices = context.decisions, directory.choices(context)
    rows = {r.request_id: (r.status, r.team_id) for r in decided.collect()}
    assert rows == {
        1: ("current", 101), 2: ("ambiguous", None), 3: ("team", 202), 4: ("invalid-team", None), 5: ("ambiguous", None),
        6: ("missing", None), 7: ("missing", None), 8: ("missing", None),
    }
    assert sorted((r.request_id, r.team_id) for r in choices.collect()) == [(2, 101), (2, 202), (5, 101), (5, 202)]


def test_scoped_requests(frame):
    one, other = "Mayores|LHC|M", "Cadetes|A|M"
    memberships = frame(
        "entity_id int, team_id int, context_key string, seq int",
        (7, 10, one, 1), (7, 11, one, 2), (8, 20, one, 1), (8, 21, other, 2), (9, 30, "", 1),
    )
    requests = frame(
        "request_id int, entity_id int, requested_team_id int, current_present boolean",
        (1, 7, None, True), (2, 7, None, False), (3, 7, 11, True), (4, 7, 99, True), (5, 8, None, False), (6, 0, None, False),
        (7, 9, None, False),
    )
    context = directory.resolve_scoped_context(requests, memberships)
    decided, choices = context.decisions, directory.choices(context)
    rows = {r.request_id: (r.status, r.team_id, r.context_key) for r in decided.collect()}
    assert rows == {
        1: ("current", None, None), 2: ("team", 10, one), 3: ("team", 11, one), 4: ("invalid-team", 99, None),
        5: ("ambiguous", None, None), 6: ("invalid", None, None), 7: ("missing", None, None),
    }
    assert sorted((r.team_id, r.context_key) for r in choices.collect()) == [(20, one), (21, other)]


def test_choices_are_stored_once_whatever_is_asked(frame):
    memberships = frame("player_id int, team_id int", *[(p, t) for p in (1, 2) for t in range(1, 6)])
    requests = frame("request_id int, player_id int, requested_team_id int", *[(i, i % 2 + 1, None) for i in range(200)])
    context = directory.resolve_player_context(requests, memberships, memberships.limit(0))
    assert context.choice_sets.count() == 10 and context.decisions.count() == 200
    assert directory.choices(context).count() == 1000
    large = 2**63 - 1
    scoped = frame("entity_id bigint, team_id bigint, context_key string, seq bigint", (1, large, "a", 0), (1, 4, "b", large), (1, large - 1, "c", 5))
    asked = frame("request_id int, entity_id bigint, requested_team_id bigint, current_present boolean", (1, 1, None, False))
    found = directory.choices(directory.resolve_scoped_context(asked, scoped))
    assert sorted((r.context_key, r.team_id) for r in found.collect()) == [("a", large), ("b", 4), ("c", large - 1)]
