"""Match sheets: two layouts, reconciliation, rejection and loading. Clubs and people are invented."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tanteo.plans import match_sheets as sheets
from tanteo.sources import csv_files

PLAYERS = """Nº Local G TAm 2 TR TAz
3 Quillfeder, Bruno Teo 4 1 - - -
14 Vantongel,  Oto - - 2 - -
21 Ilmarino Zeta, Noa 2 - - 1 -
A Briscol, Delia - - - - -
Nº Visitante G TAm 2 TR TAz
5 Zunderal, Paz 2 - 1 - -
6 Obregozo, Lía 1 - - - 1
30 Tamberlin, Kim 1 - - - -
A Mastrovo, Ana - - - - -
A Pelgrin, Uma - - - - -
Arbitros
8 Silbato, Max 9 - - - -"""
HEAD = "Copa de Prueba\r\nFecha:\n2025-04-12\nHora:\n16:30:00\nCategoria - Division:\nCadetes - Zona Norte\n"
PLAIN = f"{HEAD}Equipo local\nMolino Azul 6\nEquipo visitante\nLos Cerezos 4\n{PLAYERS}"
SPLIT = (
    f"{HEAD}EQUIPO LOCAL\nMolino Azul\n6\nGoles PT 2 ST 4 PTE 0 STE 0 P 0\n\n  Equipo   visitante\nLos Cerezos\n"
    f"Goles PT 1 ST 3 PTE 0 STE 0 P 0\n{PLAYERS}"
)


@pytest.fixture
def parse(frame):
    def build(*texts):
        return sheets.parse_sheets(frame("path string, text string", *[(str(i), t) for i, t in enumerate(texts)]))

    return build


def test_both_layouts(parse):
    plain, split = parse(PLAIN, SPLIT).orderBy("path").collect()
    for row in (plain, split):
        assert row.error is None
        assert (row.fecha, row.hora, row.categoria, row.division) == ("2025-04-12", "16:30:00", "Cadetes", "Zona Norte")
        assert (row.local_nombre, row.local_goles, row.visitante_nombre, row.visitante_goles) == ("Molino Azul", 6, "Los Cerezos", 4)
        assert [(p.dorsal, p.apellido, p.nombre, p.goles) for p in row.jugadores_local] == [
            (3, "Quillfeder", "Bruno Teo", 4), (14, "Vantongel", "Oto", 0), (21, "Ilmarino Zeta", "Noa", 2),
        ]
    assert (plain.local_metodo, plain.visitante_metodo) == ("encabezado", "encabezado")
    assert (split.local_metodo, split.visitante_metodo) == ("encabezado_separado", "parciales_PT_ST_PTE_STE")
    assert len(split.parciales) == 2


def test_summary(parse):
    row = sheets.sheet_summary(parse(PLAIN)).first()
    assert row.asDict() == {
        "path": "0", "jugadores": 6, "goles": 10, "amarillas": 1, "exclusiones_2min": 3, "rojas": 1, "azules": 1,
    }


def test_rejections(parse):
    cases = {
        PLAIN.replace("Cerezos 4", "Cerezos 5"): "Goles visitante no cierran: marcador=5, jugadores=4",
        SPLIT.replace("PT 1 ST 3", "PT 2 ST 3"): "Goles visitante no cierran: marcador=5, jugadores=4",
        SPLIT.replace("PT 1 ST 3 PTE 0 STE 0 P 0", "PT 1 ST 3 PTE 0 STE 0 P 1"):
            "La planilla de visitante tiene definición P=1; requiere validación específica",
        " \n ": "La planilla está vacía",
        PLAIN.replace("2025-04-12", "12/04/2025"): "No se pudo extraer fecha",
        PLAIN.replace("16:30:00", "16:30"): "No se pudo extraer hora",
        PLAIN.replace("Cadetes - Zona", "Cadetes Zona"): "Categoría/división inválida",
        PLAIN.replace("Equipo local", "Local"): "No se encontró Equipo local",
        SPLIT.replace("Goles PT 1 ST 3 PTE 0 STE 0 P 0\n", ""): "No se pudo extraer el marcador visitante de forma independiente",
        PLAIN.replace("Nº Visitante G TAm 2 TR TAz", "Visitante"): "No se encontró sección Nº Visitante G TAm 2 TR TAz",
        PLAIN.replace("5 Zunderal", "X Zunderal").replace("6 Obregozo", "X Obregozo").replace("30 Tamberlin", "X Tamberlin"):
            "La sección Nº Visitante G TAm 2 TR TAz no contiene jugadores",
    }
    parsed = parse(*cases)
    errors = {int(r.path): r.error for r in sheets.rejected(parsed).collect()}
    assert [errors.get(i) for i in range(len(cases))] == list(cases.values())
    assert sheets.accepted(parsed).count() == 0


def test_loading_twice_changes_nothing(spark, frame, parse):
    cards = frame("team_id int, category string, division string", (1, "Cadetes", "Zona Norte"), (2, "Cadetes", "Zona Norte"))
    matches = frame(
        "match_id int, match_date string, home_team_id int, away_team_id int, home_name string, away_name string, home_scope string, away_scope string",
        (50, "2025-04-12", 1, 2, "MOLINO azul", "Los Cerezos", "s", "s"),
    )
    players = frame("player_id int, first_name string, last_name string", (70, "Lia", "Obregozo"))
    rosters = frame("player_id int, team_id int", (70, 2))
    parsed = parse(PLAIN, PLAIN.replace("Molino Azul", "Otro Club"))
    load = sheets.sheets_to_participations(parsed, matches, cards, players, rosters)
    assert [(r.path, r.fits) for r in load.unresolved.collect()] == [("1", 0)]
    lines = {(r.team_id, r.shirt_used): r.player_id for r in load.lines.collect()}
    assert lines[2, 6] == 70 and len(lines) == 6
    assert sorted(r.player_id for r in load.new_players.collect()) == [71, 72, 73, 74, 75]
    stored = frame(
        "line_id int, match_id int, player_id bigint, team_id int, goals bigint, two_min bigint, yellow bigint, red bigint, shirt_used int",
        (1, 50, 70, 2, 9, 0, 0, 0, None), (2, 51, 70, 2, 3, 0, 0, 0, None),
    )
    once = sheets.merge_participations(stored, load.lines)
    twice = sheets.merge_participations(once, load.lines)
    assert once.count() == 7 and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.where("match_id = 50 and player_id = 70").first().goals == 1


def test_both_sides_come_from_one_parsing(parse):
    plan = sheets.sheet_players(parse(PLAIN, SPLIT))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_a_section_is_cut_in_one_pass(parse):
    """No search from a position counted from the start of the text, no lower-case copy of it; and headings are met as before."""
    plan = parse(PLAIN)._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(" not in plan and "lower(" not in plan
    cases = {
        PLAIN.replace("Equipo local\n", "x EQUİPO locAL (casa)\n"): None,
        PLAIN.replace("Equipo visitante", "Equipo v\u0131sitante"): "No se encontró Equipo visitante",
        PLAIN.replace("Equipo visitante\n", "Equipo local\nOtro 9\nEquipo visitante\n"): None,
        PLAIN.replace("Nº Local", "nº local"): "No se encontró sección Nº Local G TAm 2 TR TAz",
        f"{HEAD}Equipo local": "No se pudo extraer nombre de local",
        PLAIN.replace(PLAYERS, PLAYERS.replace("A Briscol, Delia - - - - -", "\n".join(["A Briscol, Delia - - - - -"] * 20_000))): None,
    }
    assert [r.error for r in parse(*cases).orderBy("path").collect()] == list(cases.values())


def test_scores_are_read_without_the_player_lines(spark):
    from checks.catalog import sheets as catalog

    class League:
        planillas = spark.createDataFrame([("0", PLAIN)], "path string, text string")

    for query in (catalog.sheet_score, catalog.sheet_diagnostics):
        assert "dorsal" not in query(League)._jdf.queryExecution().optimizedPlan().toString()
    assert catalog.sheet_score(League).first().local_goles == 6


def test_sheets_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PLAIN, encoding="utf-8", newline="")
    read = sheets.read_sheets(spark, str(tmp_path))
    assert read.count() == 1
    assert sheets.parse_sheets(read).first().error is None


def test_lines_keep_every_character_that_is_no_blank(frame):
    """Blanks and line ends of all kinds collapse; what symbol fonts leave in a text stays."""
    df = frame("t string", (" a\ue000  b\t\tc \r\n\n \n\u00a0d\ue000\ue000 \x0b\u2003e\n",), ("\ue000",), (" \n\t",))
    assert [r[0] for r in df.select(sheets.sheet_lines(F.col("t"))).collect()] == [["a\ue000 b c", "d\ue000\ue000 e"], ["\ue000"], []]


def test_csv_files(spark, frame, tmp_path):
    rows = frame("Jugador string, Goles int", ('Noa "Zeta"', -3), ("=7*7", None), ("  -x", 2), (None, 0), ("dos\nlíneas", 1))
    out = tmp_path / "out"
    csv_files.write_csv(rows.coalesce(1), str(out))
    (part,) = out.glob("part-*.csv")
    lines = ['"Jugador","Goles"', '"Noa ""Zeta""","-3"', '"\'=7*7",""', '"\'  -x","2"', '"","0"', '"dos\nlíneas","1"']
    assert part.read_bytes() == b"\xef\xbb\xbf" + ("\n".join(lines) + "\n").encode()
    assert {p.name for p in out.iterdir()} == {part.name, "_SUCCESS"}

    with pytest.raises(Exception, match="exists"):
        csv_files.write_csv(rows, str(out))
    csv_files.write_csv(rows.repartition(3), f"file://{out}", mode="append")
    parts = list(out.glob("part-*.csv"))
    assert len(parts) == 4 and all(p.read_bytes().startswith(b'\xef\xbb\xbf"Jugador"') for p in parts)

    # a job that fails leaves the folder as it was
    goals = F.when(F.col("Goles") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("Goles"))
    with pytest.raises(Exception, match="lost"):
        csv_files.write_csv(rows.repartition(2).withColumn("Goles", goals), str(out), mode="overwrite")
    assert set(out.glob("*")) == {*parts, out / "_SUCCESS"}
    csv_files.write_csv(rows.where("Goles > 90"), str(out), mode="overwrite")
    assert all(p.read_bytes() == b'\xef\xbb\xbf"Jugador","Goles"\n' for p in out.glob("part-*.csv"))


def _load(frame, parse, sheets_of):
    """Sheets of 12 teams' matches, loaded: every name, known or new, in several teams and sheets."""
    cards = frame("team_id int, category string, division string", *[(t, "Cadetes", "Zona Norte") for t in range(1, 13)])
    pairs = [(t, t % 12 + 1) for t in range(1, 13)]
    matches = frame(
        "match_id int, match_date string, home_team_id int, away_team_id int, home_name string, away_name string, home_scope string, away_scope string",
        *[(50 + h, "2025-04-12", h, a, f"Club {h}", f"Club {a}", "s", "s") for h, a in pairs],
    )
    players = frame("player_id int, first_name string, last_name string", (70, "Lia", "Obregozo"), (71, "lía", "OBREGOZO"), (72, "Oto", "Vantongel"))
    rosters = frame("player_id int, team_id int", (71, 3), (70, 3), (70, 5), (72, 1), (72, 9))
    texts = [PLAIN.replace("Molino Azul 6", f"Club {h} 6").replace("Los Cerezos 4", f"Club {a} 4") for h, a in pairs]
    # a second sheet of the first match, with other shirts
    texts.append(texts[0].replace("14 Vantongel", "15 Vantongel").replace("3 Quillfeder", "1 Quillfeder"))
    return sheets_of(sheets.sheets_to_participations(parse(*texts), matches, cards, players, rosters)), pairs


def test_new_players_are_numbered_by_team_and_name(spark, frame, parse):
    home = {"bruno teo quillfeder": (3, "Bruno Teo", "Quillfeder"), "noa ilmarino zeta": (21, "Noa", "Ilmarino Zeta"), "oto vantongel": (14, "Oto", "Vantongel")}
    away = {"kim tamberlin": (30, "Kim", "Tamberlin"), "lia obregozo": (6, "Lía", "Obregozo"), "paz zunderal": (5, "Paz", "Zunderal")}
    (lines, new), pairs = _load(frame, parse, lambda load: (load.lines.collect(), load.new_players.collect()))
    known = {(3, "lia obregozo"): 70, (5, "lia obregozo"): 70, (1, "oto vantongel"): 72, (9, "oto vantongel"): 72}
    expected = {k: v for t in range(1, 13) for k, v in {(t, n): w for n, w in {**home, **away}.items()}.items() if k not in known}
    ids = {key: 73 + i for i, key in enumerate(sorted(expected))}
    # of the first match's two sheets the smaller shirt names the player
    shirts = {(1, "bruno teo quillfeder"): 1}
    assert sorted((r.player_id, r.team_id, r.nombre, r.apellido, r.dorsal) for r in new) == sorted(
        (ids[k], k[0], who[1], who[2], shirts.get(k, who[0])) for k, who in expected.items()
    )
    of_shirt = {v[0]: n for n, v in {**home, **away}.items()} | {15: "oto vantongel", 1: "bruno teo quillfeder"}
    assert len(lines) == 13 * 6
    assert all(r.player_id == {**ids, **known}[r.team_id, of_shirt[r.shirt_used]] for r in lines)


def test_slices_follow_the_team_ids(spark, monkeypatch):
    """Whatever the ids, each has one slice, and slices rise with them."""
    monkeypatch.setattr(sheets, "_SLICES", 8)
    monkeypatch.setattr(sheets, "_STEP", 3)
    ids = [-5, 0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 1 << 60]
    teams = spark.createDataFrame([(i,) for i in ids for _ in range(2)], "team_id bigint")
    found = {r.team_id: r.n for r in teams.withColumn("n", sheets._by_team(teams, F.col("team_id"))).collect()}
    numbers = [found[i] for i in ids]
    assert numbers == sorted(numbers) and numbers[0] == 0 and len(set(numbers)) == 8
    one = teams.withColumn("n", sheets._by_team(teams.where("team_id = 3"), F.col("team_id")))
    assert [r.n > 0 for r in one.distinct().orderBy("team_id").collect()] == [False] * 5 + [True] * 7
    assert {r.n for r in teams.withColumn("n", sheets._by_team(teams.limit(0), F.col("team_id"))).collect()} == {0}


def test_new_players_cost_one_dealing_of_lines(spark, frame, parse, monkeypatch):
    """What is stored holds the numbers already: no line is dealt again for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (new, lines), _ = _load(frame, parse, lambda load: (load.new_players, load.lines))
        for found in (new, lines):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merging_deals_lines_once_and_keeps_the_greatest(spark, frame):
    stored = frame(
        "line_id int, match_id int, player_id bigint, team_id int, goals bigint",
        (1, 50, 70, 2, 9), (2, 50, 70, 2, 8), (3, 51, 70, 2, 3), (4, None, 70, 2, 4), (5, None, 70, 2, 4),
    )
    stats = "goles bigint, tarjeta_amarilla bigint, exclusiones_2min bigint, tarjeta_roja bigint, tarjeta_azul bigint"
    lines = frame(
        f"path string, match_id int, team_id int, player_id bigint, shirt_used bigint, {stats}",
        ("a", 50, 2, 70, 9, 7, 0, 0, 0, 0), ("b", 50, 2, 70, 1, 5, 1, 0, 0, 0), ("b", 50, 2, 70, None, 6, 1, 0, 0, 0),
        ("b", 50, 2, 70, 1, 5, 1, 0, 0, None), ("a", 50, 2, 71, None, None, 0, 0, 0, 0), ("a", None, 2, 70, 3, 2, 0, 0, 0, 0),
    )
    merged = sheets.merge_participations(stored, lines)
    assert merged.columns == ["line_id", "match_id", "player_id", "team_id", "goals", "shirt_used", "yellow", "two_min", "red"]
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted([
        (3, 51, 70, 2, 3, None, None, None, None), (4, None, 70, 2, 4, None, None, None, None), (5, None, 70, 2, 4, None, None, None, None),
        (None, 50, 70, 2, 5, 1, 1, 0, 0), (None, 50, 71, 2, None, None, 0, 0, 0), (None, None, 70, 2, 2, 3, 0, 0, 0),
    ], key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sheets.merge_participations(stored, lines)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
