"""Publications, batch checks, synchronisation, review queue and team sync."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tanteo.plans import fixture_import as sync
from tanteo.plans import publications, team_sync
from tanteo.schemas import CLUB_ALIASES, CLUBES, EQUIPOS, IMPORT_REVISION, PARTIDOS, TEMPORADAS

FEED = (
    "seq int, fecha string, hora string, categoria string, division string, rama string, local string, visitante string, "
    "local_equipo_codigo string, visitante_equipo_codigo string, tipo_fuente string, local_equipo_id int, visitante_equipo_id int"
)
BASE = {
    "fecha": "2025-04-12", "hora": "16:30", "categoria": "Cadetes", "division": "Zona Norte", "rama": "F",
    "local": "Molino Azul", "visitante": "Los Cerezos", "local_equipo_codigo": "A",
    "visitante_equipo_codigo": "C", "tipo_fuente": "fecha_normal", "local_equipo_id": None, "visitante_equipo_id": None,
}
PARTS = {
    "fecha": ["2025-04-12", "2025-04-19", "2025-04-20", " "], "hora": ["16:30", "16:30:00", "19:15", None], "categoria": ["Cadetes", "CADETES ", "Menores", ""],
    "division": ["Zona Norte"], "rama": ["F", " f", "X"], "local": ["Molino Azul", "molino  azul", "Faro"], "visitante": ["Los Cerezos", "Molino Azul"],
    "local_equipo_codigo": ["A", "b", None, " "], "visitante_equipo_codigo": ["C"], "tipo_fuente": ["fecha_normal", "reprogramacion", "otra"],
}
#: Of the first value of each part so many in ten (what is left is drawn from all): most publications are sound, and match-ups recur.
USUAL = 9


def publication(source):
    row = {c: v[0] if source.random() < USUAL / 10 else source.choice(v) for c, v in PARTS.items()}
    row["tipo_fuente"] = source.choice(PARTS["tipo_fuente"][:2]) if row["tipo_fuente"] != "otra" else "otra"
    home, away = source.choice([(None, None)] * 25 + [(31, 32 + source.randint(0, 40))] * 20 + [(31, None), (31, 31), (0, 0)])
    return row | {"division": f"Zona {source.randint(1, 40)}", "local_equipo_id": home, "visitante_equipo_id": away}


def identity(row):
    """(match-up, None) or (None, what is wrong with the publication)."""
    text = lambda c: (row[c] or "").strip()
    key = lambda c: " ".join(text(c).lower().split())
    home, away = (row[c] if (row[c] or 0) > 0 else None for c in ("local_equipo_id", "visitante_equipo_id"))
    codes = [("A" if row[c] is None else text(c)).upper() for c in ("local_equipo_codigo", "visitante_equipo_codigo")]
    named = home is None and away is None
    wrong = [
        (not text("categoria"), "Fixture sin categoria"), (text("rama").upper() not in ("M", "F"), f"Rama inválida: {text('rama').upper()}"),
        ((home is None) != (away is None), "Fixture con un solo equipo_id resuelto"),
        (home is not None and home == away, "Local y visitante no pueden ser el mismo equipo"),
        (named and key("local") == key("visitante"), "Clubes local/visitante inválidos"), (named and "" in codes, "Fixture sin equipo_codigo"),
        (row["tipo_fuente"] == "otra", "tipo_fuente inválido: otra"), (not text("fecha"), "Fixture sin fecha"),
    ]
    error = next((message for bad, message in wrong if bad), None)
    if error:
        return None, error
    return ((home, away) if not named else (text("rama").upper(), key("categoria"), key("division"), key("local"), codes[0], key("visitante"), codes[1])), None


def priority(rows):
    """The rule in plain words: per match-up, equal dates and times count once; a single rescheduling wins, several are ambiguous; without
    one, a single date wins. Gives the winners by their number, with what they are and replace, and the number of ambiguous match-ups."""
    matchups: dict = {}
    for seq, row in enumerate(rows):
        scope, error = identity(row)
        if not error:
            when = (row["fecha"].strip(), (row["hora"] or "").strip()[:5])
            matchups.setdefault(scope, {}).setdefault(row["tipo_fuente"], {}).setdefault(when, []).append(seq)
    winners, ambiguous = {}, []
    for kinds in matchups.values():
        normal, moved = kinds.get("fecha_normal", {}), kinds.get("reprogramacion", {})
        versions = sum(len(seqs) for kind in (normal, moved) for seqs in kind.values())
        if len(moved) > 1 or (not moved and len(normal) > 1):
            ambiguous.append(("multiples_reprogramaciones" if moved else "mismo_cruce_repetido", versions))
            continue
        (first, *_) = (moved or normal).values()
        replaced = rows[next(iter(normal.values()))[0]] if moved and len(normal) == 1 else None
        winners[first[0]] = ("reprogramacion" if moved else "fecha_normal", versions, replaced and replaced["fecha"], replaced and replaced["hora"])
    return winners, sorted(ambiguous)


@pytest.mark.parametrize("seed", range(3))
def test_publications_follow_the_rule(frame, seed):
    source = random.Random(seed)
    rows = [publication(source) for _ in range(250)]
    columns = [c.split()[0] for c in FEED.split(", ")][1:]
    result = publications.prioritize(frame(FEED, *[(i, *(row[c] for c in columns)) for i, row in enumerate(rows)]))
    errors = {r.seq: r.error for r in result.rejected.collect()}
    assert errors == {i: error for i, row in enumerate(rows) if (error := identity(row)[1])}
    winners, ambiguous = priority(rows)
    found = {
        r.seq: (r.fuente_priorizada, r.versiones_detectadas, r.fecha_programacion_original, r.hora_programacion_original)
        for r in result.selected.collect()
    }
    assert found == winners
    assert sorted((r.tipo, r.versiones_detectadas) for r in result.ambiguous.collect()) == ambiguous
    assert len(winners) > 30 and ambiguous and len(set(errors.values())) > 5


def test_winners_without_an_original_do_not_meet(spark, frame):
    """They look for one by a number of their own, not by null, which would bring them all into one task."""
    rows = [(i, *{**BASE, "local_equipo_id": 2 * i + 1, "visitante_equipo_id": 2 * i + 2}.values()) for i in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        selected = publications.prioritize(frame(FEED, *rows)).selected
        (join,) = [line for line in selected._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in line]
        assert selected.count() == 400 and selected.where("fecha_programacion_original IS NOT NULL").count() == 0
        assert "xxhash64(scope" in selected._jdf.queryExecution().optimizedPlan().toString() and "_original" in join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_publications_with_one_number_leave_one(frame):
    """``seq`` may repeat: equal publications are one, and of different ones under one number any may win."""
    row = tuple(BASE.values())
    result = publications.prioritize(frame(FEED, (4, *row), (4, *row), (9, *row)))
    (found,) = result.selected.collect()
    assert (found.seq, found.versiones_detectadas, result.ambiguous.count()) == (4, 3, 0)


ROW = {
    "temporada_id": 3, "competencia_id": 3, "fecha": "2026-09-05", "hora": "18:00", "jornada": 4, "local_equipo_id": 1,
    "visitante_equipo_id": 2, "programacion_url": "https://x/p", "programacion_pdf_url": "https://x/p.pdf",
    "tipo_fuente": "fecha_normal", "observaciones": "",
}


@pytest.fixture
def base(spark):
    def rows(schema, *items):
        names = [f.name for f in schema]
        return spark.createDataFrame([tuple(item.get(n) for n in names) for item in items], schema)

    team = {"temporada_id": 3, "categoria": "Mayores", "division": "LHC", "rama": "M", "equipo_codigo": "A", "activo": True}
    return {
        "rows": rows,
        "temporadas": rows(TEMPORADAS, {"id": 3, "competencia_id": 3}, {"id": 4, "competencia_id": 4}),
        "equipos": rows(
            EQUIPOS, {"id": 1, "club_id": 1, **team}, {"id": 2, "club_id": 2, **team},
            {"id": 3, "club_id": 3, **team, "activo": False}, {"id": 4, "club_id": 4, **team, "temporada_id": 4},
            {"id": 5, "club_id": 5, **team, "division": "B"}, {"id": 6, "club_id": 6, **team}, {"id": 7, "club_id": 7, **team},
        ),
    }


def batches(frame, *payloads):
    texts = [p if isinstance(p, str) or p is None else json.dumps([ROW | change for change in p]) for p in payloads]
    return frame("batch_id int, payload string", *enumerate(texts))


def test_first_broken_rule_of_each_row(frame, base):
    cases = [
        ({"temporada_id": ""}, "temporada_id requerido"), ({"temporada_id": "x"}, "temporada_id inválido"),
        ({"competencia_id": None}, "competencia_id requerido"), ({"local_equipo_id": -1}, "IDs de equipos inválidos"),
        ({"visitante_equipo_id": 1}, "Local y visitante no pueden ser el mismo equipo"), ({"fecha": ""}, "fecha requerida"),
        ({"tipo_fuente": None}, "tipo_fuente inválido: null"), ({"programacion_url": " "}, "programacion_url requerida"),
        ({"programacion_pdf_url": ""}, "programacion_pdf_url requerida"), ({"temporada_id": 9}, "temporada inexistente: 9"),
        ({"competencia_id": 8}, "competencia 8 no corresponde a temporada 3"),
        ({"visitante_equipo_id": 3}, "equipo inexistente o inactivo"), ({"visitante_equipo_id": 4}, "equipo fuera de temporada"),
        ({"visitante_equipo_id": 5}, "cruce entre scopes competitivos distintos"), ({"hora": "25:00"}, "hora inválida"),
    ]
    verdicts, checked = sync.preflight(batches(frame, [change for change, _ in cases]), base["temporadas"], base["equipos"])
    assert [r.error for r in checked.orderBy("idx").collect()] == [error for _, error in cases]
    verdict = verdicts.first()
    assert (verdict.ok, verdict.total, verdict.invalidos) == (False, len(cases), len(cases))


def test_batch_verdicts(frame, base):
    moved = {"fecha": "2026-09-06"}
    frames = batches(frame, [{}], [], "{}", "no json", [{}] * 201, [{}, {}], [{}, moved], [{}, {"tipo_fuente": "reprogramacion"}], None)
    verdicts, checked = sync.preflight(frames, base["temporadas"], base["equipos"], 200)
    assert checked.where("batch_id = 4").count() == 201
    assert sync.preflight(frames, base["temporadas"], base["equipos"])[0].where("batch_id = 4").first().error is None
    rows = verdicts.orderBy("batch_id").collect()
    assert [r.ok for r in rows] == [True, False, False, False, False, False, False, True, False]
    assert [r.error for r in rows][1:5] == [
        "lote vacío", "p_partidos debe ser un array JSON", "p_partidos debe ser un array JSON", "lote excede 200 partidos",
    ]
    assert (rows[5].duplicate_payload_groups, rows[6].ambiguous_schedule_pairs) == (1, 1)


def stored(base):
    match = {
        "competencia_id": 3, "temporada_id": 3, "fecha": "2026-09-05", "hora": "18:00:00", "jornada": 1, "estado": "programado",
        "observaciones": "nota",
    }
    pairs = [
        (10, 1, 2, {}),  # same schedule: refreshed
        (11, 2, 1, {"fecha": "2026-08-01", "hora": None}),  # scheduled elsewhere: moved
        (12, 1, 6, {"fecha": "2026-08-01", "estado": "finalizado", "goles_local": 20, "goles_visitante": 21}),  # played: review
        (13, 6, 1, {}), (14, 6, 1, {"fecha": "2026-10-01"}),  # two matches: review
    ]
    text = PARTIDOS["fecha"].dataType
    df = base["rows"](
        type(PARTIDOS)([f if f.name != "fecha" else type(f)("fecha", PARTIDOS["estado"].dataType) for f in PARTIDOS]),
        *[{"id": i, "local_equipo_id": h, "visitante_equipo_id": a, **match, **extra} for i, h, a, extra in pairs],
    )
    return df.withColumn("fecha", F.col("fecha").cast(text))


BATCH = [
    {}, {"local_equipo_id": 2, "visitante_equipo_id": 1, "jornada": ""}, {"visitante_equipo_id": 6},
    {"local_equipo_id": 6, "visitante_equipo_id": 1}, {"visitante_equipo_id": 7, "hora": ""},
]


def run(frame, base, matches, queue, *payloads):
    verdicts, result = sync.import_batches(
        batches(frame, *payloads), base["temporadas"], base["equipos"], matches, queue, "2026-09-01 00:00:00", "la liga"
    )
    return verdicts, result


def snapshot(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_every_action_and_a_second_run(frame, base):
    empty = base["rows"](IMPORT_REVISION)
    _, first = run(frame, base, stored(base), empty, BATCH)
    counters = first.counters.first().asDict()
    assert {k: counters[k] for k in ("insertados", "ya_existentes", "reprogramados", "revision", "errores")} == {
        "insertados": 1, "ya_existentes": 1, "reprogramados": 1, "revision": 2, "errores": 0,
    }
    rows = {r.id: r for r in first.matches.collect()}
    assert rows[10].jornada == 4 and rows[10].observaciones == "nota" and rows[10].programacion_url == "https://x/p"
    assert (str(rows[11].fecha), rows[11].hora, rows[11].jornada) == ("2026-09-05", "18:00:00", 1)
    assert rows[11].observaciones == "Reprogramado automáticamente desde la liga. Fecha anterior: 2026-08-01 sin hora"
    assert (rows[12].estado, str(rows[12].fecha)) == ("finalizado", "2026-08-01")
    assert (rows[15].estado, rows[15].hora, rows[15].goles_local) == ("programado", None, None)
    assert {r.tipo for r in first.reviews.collect()} == {"partido_finalizado_fecha_distinta", "partido_cruce_ambiguo"}
    _, second = run(frame, base, first.matches, first.reviews, BATCH)
    assert snapshot(second.matches) == snapshot(first.matches)
    assert snapshot(second.reviews) == snapshot(first.reviews)
    assert second.counters.first().insertados == 0


def test_a_broken_row_keeps_the_whole_batch_out(frame, base):
    empty = base["rows"](IMPORT_REVISION)
    verdicts, result = run(frame, base, stored(base), empty, [{"visitante_equipo_id": 7}, {"visitante_equipo_id": 3}])
    assert verdicts.first().ok is False
    assert snapshot(result.matches) == snapshot(stored(base))
    assert result.reviews.count() == 0


def test_later_batches_meet_what_earlier_ones_left(frame, base):
    """Inserted, repeated, moved, moved back: the same as one call per batch."""
    empty = base["rows"](IMPORT_REVISION)
    pair = {"visitante_equipo_id": 7}
    days = ["2026-09-05", "2026-09-05", "2026-09-06", "2026-09-05"]
    _, at_once = run(frame, base, stored(base), empty, *[[pair | {"fecha": day, "jornada": ""}] for day in days])
    assert [r.accion for r in at_once.decisions.orderBy("batch_id").collect()] == [
        "insertado", "ya_existente", "reprogramado", "reprogramado",
    ]
    matches, queue = stored(base), empty
    for day in days:
        _, step = run(frame, base, matches, queue, [pair | {"fecha": day, "jornada": ""}])
        matches, queue = step.matches, step.reviews
    assert snapshot(at_once.matches) == snapshot(matches)


def test_unreadable_round_goes_to_review_once(frame, base):
    empty = base["rows"](IMPORT_REVISION)
    payload = [{"visitante_equipo_id": 7, "jornada": "x"}]
    _, result = run(frame, base, stored(base), empty, payload)
    assert result.counters.first().errores == 1
    assert [r.tipo for r in result.reviews.collect()] == ["error_sync_partido"]
    _, again = run(frame, base, result.matches, result.reviews, payload)
    assert snapshot(again.reviews) == snapshot(result.reviews)


def test_teams_are_found_created_and_named(frame, base):
    rows = base["rows"]
    clubs = rows(CLUBES, {"id": 1, "nombre": "Molino Azul", "activo": True}, {"id": 2, "nombre": "C.D.L.", "activo": True},
                 {"id": 9, "nombre": "Viejo", "activo": False})
    aliases = rows(CLUB_ALIASES, {"id": 5, "club_id": 2, "alias": "CDL Cerezos", "alias_normalizado": "cdl cerezos", "activo": True})
    requests = frame(
        "seq int, club_nombre string, temporada_id int, categoria string, division string, rama string, equipo_codigo string, nombre_federacion string",
        (1, "MOLINO  azul", 3, "Mayores", "LHC", "m", None, "Molino"),
        (2, "Cdl Cerezos", 3, "Mayores", "Nueva", "M", "b", None),
        (3, "CDL cerezos", 3, "Mayores", "Nueva", "M", "B", "Cdl B"),
        (4, "Viejo", 3, "Mayores", "LHC", "M", "A", None),
        (5, "C.D.L.", 7, "Mayores", "LHC", "M", "A", None),
        (6, "C.D.L.", 3, "Mayores", "LHC", "X", "A", None),
    )
    result = team_sync.sync_teams(requests, base["temporadas"], clubs, base["equipos"], aliases)
    found = {r.seq: r for r in result.results.collect()}
    assert (found[1].equipo_id, found[1].equipo_creado) == (1, False)
    assert (found[2].equipo_id, found[2].equipo_creado, found[3].equipo_id, found[3].equipo_creado) == (8, True, 8, False)
    assert found[4].error == "Club no reconocido: Viejo. Agregar alias confirmado antes de sincronizar."
    assert (found[5].error, found[6].error) == ("temporada_id inexistente o requerido: 7", "rama invalida: X")
    teams = {r.id: r for r in result.teams.collect()}
    assert (teams[1].nombre_federacion, teams[8].nombre_federacion, teams[8].equipo_codigo) == ("Molino", "Cdl B", "B")
    learned = {r.alias_normalizado: (r.id, r.club_id) for r in result.aliases.collect()}
    assert learned == {"cdl cerezos": (5, 2), "molino azul": (6, 1)}


def test_what_several_steps_read_is_computed_once(spark, frame, base):
    verdicts, result = run(frame, base, stored(base), base["rows"](IMPORT_REVISION), BATCH, [])
    # the verdicts are a stored table, for the gate's branches and the log
    assert verdicts.inputFiles() and "json_array_length" not in verdicts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.batch_id, r.ok) for r in verdicts.collect()) == [(0, True), (1, False)]
    # so are the changes, which the kept and the new matches read: no aggregate of the decisions is left in the plan
    plan = result.matches._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan and "accion" not in plan
    # fixtures are not sorted to meet their teams
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sync.fixture_rows(batches(frame, BATCH))
        plan = sync.preflight_rows(rows, base["temporadas"], base["equipos"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("ShuffledHashJoin") == 2


def test_a_repeated_error_keeps_the_first_entry_and_a_repeated_review_the_last(frame):
    fields = "batch_id bigint, idx bigint, fingerprint string, tipo string, fuente_url string, fuente_pdf_url string, payload string, estado string, observaciones string"
    rows = [
        (batch, idx, mark, kind, f"{batch}-{idx}", "p", "{}", "pendiente", "o")
        for mark, kind in (("e", sync.REVIEW_ERROR), ("m", sync.REVIEW_MOVED)) for batch, idx in ((2, 1), (10, 3), (2, 9), (10, 12))
    ]
    merged = sync.merge_reviews(frame(", ".join(f"{f.name} string" for f in IMPORT_REVISION)), frame(fields, *rows))
    assert {r.fingerprint: r.fuente_url for r in merged.collect()} == {"e": "2-1", "m": "10-12"}
