"""Import runs and the feed: whole or not at all, once whatever is repeated, the same in any number of micro-batches."""

from __future__ import annotations

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tanteo.plans import import_job
from tanteo.schemas import CLUB_ALIASES, CLUBES, EQUIPOS, PARTIDOS, TEMPORADAS
from tanteo.sources.snapshots import SnapshotStore
from tanteo.streaming.fixture_feed import start_feed

RUN_AT = "2025-03-01 08:00:00"
TEAMS = 6


def league(spark):
    def rows(schema, *items):
        names = [f.name for f in schema]
        return spark.createDataFrame([tuple(item.get(n) for n in names) for item in items], schema)

    team = {"temporada_id": 8, "categoria": "Cadetes", "division": "Zona Norte", "rama": "F", "equipo_codigo": "A", "activo": True}
    matches = rows(PARTIDOS).select([c for c in PARTIDOS.names if c != "fecha"]).withColumn("fecha", F.lit(None).cast("date")).select(PARTIDOS.names)
    played = spark.sql(
        "SELECT 50L id, 5L competencia_id, 8L temporada_id, date'2025-03-08' fecha, '11:00:00' hora, 1 jornada, 1L local_equipo_id, "
        "2L visitante_equipo_id, 'finalizado' estado, 20 goles_local, 21 goles_visitante"
    )
    return {
        "temporadas": rows(TEMPORADAS, {"id": 8, "competencia_id": 5}),
        "clubes": rows(CLUBES, *[{"id": i, "nombre": f"Club {i}", "activo": True} for i in range(1, TEAMS + 1)]),
        "equipos": rows(EQUIPOS, *[{"id": i, "club_id": i, **team} for i in range(1, TEAMS + 1)]),
        "club_aliases": rows(CLUB_ALIASES),
        "partidos": matches.unionByName(played, allowMissingColumns=True),
    }


def published(seed: int, n: int) -> list[tuple[int, str]]:
    """Batches of one to three fixtures; some repeat, move or break a fixture."""
    source = random.Random(seed)
    out = []
    for number in range(n):
        rows = []
        for home, away in source.sample([(h, a) for h in range(1, TEAMS + 1) for a in range(1, TEAMS + 1) if h != a], source.randint(1, 3)):
            rows.append({
                "temporada_id": 8, "competencia_id": 5, "fecha": f"2025-04-{source.randint(1, 3):02d}", "hora": source.choice(["", "18:00", "19:30"]),
                "jornada": source.choice(["", "4", "5", "x"]), "local_equipo_id": home, "visitante_equipo_id": away if source.random() > 0.05 else 99,
                "programacion_url": f"https://liga.example/{number}", "programacion_pdf_url": f"https://liga.example/{number}.pdf",
                "tipo_fuente": source.choice(["fecha_normal", "reprogramacion"]), "observaciones": "",
            })
        out.append((number, json.dumps(rows) if source.random() > 0.05 else "{}"))
    return out


def state(store):
    return {
        name: sorted(map(str, store.read(name).drop("app", "run").collect()))
        for name in ("partidos", "import_revision", "import_log") if name in store.manifest().tables
    }


@pytest.fixture
def store(spark, tmp_path):
    made = SnapshotStore(spark, f"file://{tmp_path}/store")
    import_job.open_league(made, league(spark))
    return made


def frame_of(spark, batches):
    return spark.createDataFrame(batches, "batch_id bigint, payload string")


def test_a_run_switches_all_its_tables_and_a_repeat_changes_nothing(spark, store):
    batches = frame_of(spark, published(1, 12))
    before = state(store)
    done = import_job.import_fixtures(store, 1, batches, RUN_AT)
    after = state(store)
    assert done.applied and after["partidos"] != before["partidos"] and len(after["import_log"]) == 12
    assert not import_job.import_fixtures(store, 1, batches, RUN_AT).applied and state(store) == after
    # the same fixtures as a new run meet themselves: matches stay, only the log grows
    import_job.import_fixtures(store, 2, batches.where("batch_id = 0"), RUN_AT)
    assert len(state(store)["import_log"]) == 13


def test_a_run_killed_before_the_switch_leaves_the_old_tables(spark, store, monkeypatch):
    batches = frame_of(spark, published(2, 8))
    before = state(store)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "_switch", die)
        with pytest.raises(KeyboardInterrupt):
            import_job.import_fixtures(store, 1, batches, RUN_AT)
    assert state(store) == before and store.versions() == [1]
    import_job.import_fixtures(store, 1, batches, RUN_AT)
    other = SnapshotStore(spark, store.root + "-other")
    import_job.open_league(other, league(spark))
    import_job.import_fixtures(other, 1, batches, RUN_AT)
    assert state(store) == state(other)


def land(folder, batches):
    """One file of batches; a file is complete before it is in the folder."""
    name = f"{batches[0][0]:05d}.json"
    draft = folder.parent / f"draft-{name}"
    draft.write_text("".join(json.dumps({"batch_id": i, "payload": p}) + "\n" for i, p in batches))
    os.utime(draft, (1_700_000_000 + batches[0][0],) * 2)  # the stream takes files by their time
    shutil.move(draft, folder / name)


def test_the_feed_gives_the_same_tables_in_one_or_five_batches_and_after_a_restart(spark, tmp_path, monkeypatch):
    batches = published(3, 25)
    parts = [batches[i : i + 5] for i in range(0, 25, 5)]
    results = []
    for name, per_trigger in (("one", None), ("five", 1)):
        folder = tmp_path / name
        folder.mkdir()
        for part in parts:
            land(folder, part)
        made = SnapshotStore(spark, f"file://{tmp_path}/store-{name}")
        import_job.open_league(made, league(spark))
        start_feed(made, str(folder), str(tmp_path / f"check-{name}"), RUN_AT, files_per_trigger=per_trigger).awaitTermination(300)
        results.append(state(made))
        assert len(made.versions()) == (2 if per_trigger is None else 6)
    assert results[0]["partidos"] == results[1]["partidos"] and results[0]["import_revision"] == results[1]["import_revision"]

    # a stream that dies after its commit, before its checkpoint knows: the micro-batch comes again and changes nothing
    folder, made = tmp_path / "again", SnapshotStore(spark, f"file://{tmp_path}/store-again")
    folder.mkdir()
    import_job.open_league(made, league(spark))
    land(folder, parts[0])
    land(folder, parts[1])
    commit = SnapshotStore.commit
    seen = []

    def dies_once(self, run, *args, **kwargs):
        done = commit(self, run, *args, **kwargs)
        seen.append(run)
        if len(seen) == 2:
            raise RuntimeError("executor gone")
        return done

    with monkeypatch.context() as patch:
        patch.setattr(SnapshotStore, "commit", dies_once)
        query = start_feed(made, str(folder), str(tmp_path / "check-again"), RUN_AT, files_per_trigger=1)
        with pytest.raises(Exception, match="executor gone"):
            query.awaitTermination(300)
    for part in parts[2:]:
        land(folder, part)
    start_feed(made, str(folder), str(tmp_path / "check-again"), RUN_AT, files_per_trigger=1).awaitTermination(300)
    assert state(made) == results[1]


def test_teams_and_aliases_switch_together(spark, store):
    requests = spark.createDataFrame(
        [(1, "CLUB  1", 8, "Cadetes", "Zona Sur", "f", "b", None), (2, "Nadie", 8, "Cadetes", "Zona Sur", "f", "b", None)],
        "seq int, club_nombre string, temporada_id int, categoria string, division string, rama string, equipo_codigo string, nombre_federacion string",
    )
    assert import_job.import_teams(store, 1, requests).applied
    assert not import_job.import_teams(store, 1, requests).applied
    assert store.read("equipos").count() == TEAMS + 1 and store.read("club_aliases").count() == 1
    assert sorted(r.error is None for r in store.read("team_log").collect()) == [False, True]
