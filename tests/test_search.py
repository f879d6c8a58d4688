"""Search by the gram index beside reading every text for every term."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tanteo.operators import search
from tanteo.sources.snapshots import SnapshotStore


@pytest.fixture(scope="module")
def texts():
    source = random.Random(11)
    words = ["norte", "sur", "año", "club", "ab", "aba", "ñandú", "x1", "perez 7", "77", "m · a"]
    names = [" ".join(source.choices(words, k=source.randint(1, 4))) for _ in range(150)] + ["", "a", "ab", "perez 77", "perez 77"]
    return [("club" if i % 3 else "player", i, None if i % 2 else i % 5, n, "c", folded(n)) for i, n in enumerate(names)]


def folded(text):
    return text.translate(str.maketrans("ñú", "nu")).strip().lower()


@pytest.fixture(scope="module")
def store(spark, texts, tmp_path_factory):
    made = SnapshotStore(spark, f"file://{tmp_path_factory.mktemp('search')}")
    frame = spark.createDataFrame(texts, "type string, id int, team_id int, name string, context string, normalized string")
    search.build(made, frame, buckets=3)
    search.build(made, frame.limit(0), buckets=3)  # the same run again changes nothing
    return made


def plain(texts, term, k):
    """(rank, id) of the best texts; the names hold ñ, which stays a letter of its own between n and o."""
    letters = {"ñ": "n￿", "ú": "u", "á": "a"}
    key = lambda name: "".join(letters.get(c, c) for c in name)
    found = [
        (0 if n == term else 1 if n.startswith(term) else 2, key(name), kind, i, team is not None, team or 0)
        for kind, i, team, name, _, n in texts if term in n
    ]
    return [(r[0], r[3]) for r in sorted(found)[:k]]


def test_every_answer_is_that_of_reading_all_texts(spark, store, texts):
    source = random.Random(12)
    terms = {n[a : a + m] for *_, n in texts for a in [source.randint(0, max(0, len(n) - 1))] for m in (1, 2, 3, 5, 9)}
    terms |= {"norte", "perez 77", "zzz", "nortez", "a", "  ", "", "club norte sur"}
    frame = spark.createDataFrame([(t,) for t in terms] + [(None,), ("NORTE",), (" Norte ",)], "term string")
    for k in (3, 12):
        found = {}
        for r in search.search(store, frame, k).orderBy("term", "pos").collect():
            found.setdefault(r.term, []).append((r["rank"], r.id))
        wanted = {t: plain(texts, t, k) for t in map(folded, terms) if t}
        short = {t: [x[0] for x in v] for t, v in found.items()}
        assert short == {t: [x[0] for x in v] for t, v in wanted.items() if v}
        # letters sort as the collation has them; where names are plain, the very rows are the same
        assert all(found[t] == v for t, v in wanted.items() if v and t.isascii() and "·" not in "".join(texts[i][3] for _, i in v))


def test_no_text_meets_a_term_that_shares_nothing_with_it(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search.search(store, spark.createDataFrame([("norte",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_more_answers_than_the_index_keeps_are_refused(spark, store):
    with pytest.raises(ValueError, match="50"):
        search.search(store, spark.createDataFrame([("a",)], "term string"), 51)


def test_rows_are_numbered_in_the_order_of_their_names(store):
    """Answers are ordered by these numbers; nothing collates names once the index is built."""
    rows = store.read("search_rows")
    named = rows.orderBy(F.collate("name", "es_CI_AI"), "type", "id", F.asc_nulls_first("team_id")).select("row_id").collect()
    assert [r.row_id for r in named] == list(range(1, len(named) + 1))
    plan = search.search(store, rows.select(F.col("name").alias("term")))._jdf.queryExecution().optimizedPlan().toString()
    assert "collat" not in plan.lower()


@pytest.fixture(scope="module")
def members():
    """Players of several teams: the text is the name and the team's context behind it."""
    source = random.Random(21)
    names = [f"{first} {last} {n}" for n, (first, last) in enumerate(zip("Ana Lía Ana Zoe Lía Ana".split(), "Paz Río Paz Sol Gil Río".split()))] * 2
    names += ["Ana", "", "Ana Paz"]
    contexts = [f"Club {n} · Mayores · {division} · Femenino" for n in range(9) for division in ("A", "B")]
    plain_text = lambda x: x.lower().replace("í", "i").strip()
    rows = []
    for i, name in enumerate(names):
        for team in source.sample(range(len(contexts)), 7):
            rows.append(("player", i, team, name, contexts[team], plain_text(f"{name} {contexts[team]}")))
        rows.append(("player", i, None, name, "Jugador", plain_text(name)))
    rows.append(("club", 1, None, "x", "Club", "other text than its name"))
    return rows


def test_terms_across_name_and_context(spark, members, tmp_path):
    """Answers inside the name, inside the context and from one into the other are those of reading all texts."""
    made = SnapshotStore(spark, f"file://{tmp_path}")
    search.build(made, spark.createDataFrame(members, "type string, id int, team_id int, name string, context string, normalized string"))
    source = random.Random(22)
    terms = {n[a : a + m].strip() for *_, n in members for a in [source.randint(0, max(0, len(n) - 1))] for m in (1, 2, 4, 7, 14, 30)}
    terms |= {n for *_, n in members} | {"z 2 club", "0 c", "paz club", "a · femenino", "ana club 1 ", "na paz 2 club 7 · mayores · b", "gil 44 club"}
    numbers = {(r.type, r.id, r.team_id): r.row_id for r in made.read("search_rows").collect()}
    rank = lambda n, t: 0 if n == t else 1 if n.startswith(t) else 2
    for k in (1, 5, 50):
        found = search.search(made, spark.createDataFrame([(t,) for t in terms], "term string"), k).collect()
        got = {}
        for r in sorted(found, key=lambda r: r.pos):
            got.setdefault(r.term, []).append((r["rank"], numbers[r.type, r.id, r.team_id]))
        wanted = {t: sorted((rank(n, t), numbers[kind, i, team]) for kind, i, team, _, _, n in members if t in n)[:k] for t in map(str.strip, terms) if t}
        assert got == {t: v for t, v in wanted.items() if v}
        assert all(r.pos == p + 1 for t in got for p, r in enumerate(sorted((r for r in found if r.term == t), key=lambda r: r.pos)))


def test_names_and_contexts_are_indexed_once(spark, members, tmp_path):
    """The index grows with the different names and contexts, not with the letters of every player of every team."""
    made = SnapshotStore(spark, f"file://{tmp_path}")
    schema = "type string, id int, team_id int, name string, context string, normalized string"
    search.build(made, spark.createDataFrame(members, schema))
    tables = ("search_postings", "search_edges", "search_texts")
    sizes = [made.read(t).count() for t in tables]
    search.build(made, spark.createDataFrame([(a, 10 * i + j, *b) for a, i, *b in members for j in range(9)], schema), ("search", 2))
    assert [made.read(t).count() for t in tables] == sizes


def test_a_long_term_meets_only_parts_that_hold_six_of_its_letters(spark, tmp_path):
    """Candidates do not grow with terms times texts: numbers share grams of three letters, hardly any of six."""
    made = SnapshotStore(spark, f"file://{tmp_path}")
    people = [("player", i, None, f"Paz {i}", "Jugador", f"paz {i}") for i in range(100_000, 103_000)]
    search.build(made, spark.createDataFrame(people, "type string, id int, team_id int, name string, context string, normalized string"))
    terms = [f"paz {i}" for i in range(100_000, 103_000, 10)]
    sizes = {r.gram: r.texts for r in made.read("search_grams").collect()}
    assert max(min(sizes["0" + t[i : i + 6]] for i in range(len(t) - 5)) for t in terms) == 1
    found = search.search(made, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {r.id - 100_000 for r in found.collect()} == set(range(0, 3_000, 10))
