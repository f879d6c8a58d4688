"""Value rules: ages, cells, links, categories, numbers, responses."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tanteo.functions import dates, labels, numbers, text, web


def values(df, column):
    return [row[0] for row in df.orderBy("i").select(column).collect()]


@pytest.fixture
def texts(spark):
    def build(*items: str | None):
        return spark.createDataFrame(list(enumerate(items)), "i int, x string")

    return build


def test_age_follows_the_league_day(frame):
    cases = [
        ("1998-05-20", "2025-05-20 02:59:00", 26),  # still the day before in the league
        ("1998-05-20", "2025-05-20 03:00:00", 27),
        ("1996-02-29", "2023-02-28 15:00:00", 26),
        ("1996-02-29", "2024-02-29 15:00:00", 28),
        ("1997-02-29", "2025-05-20 15:00:00", None),
        ("1999-04-31", "2025-05-20 15:00:00", None),
        ("20-05-1998", "2025-05-20 15:00:00", None),
        ("2031-07-01", "2025-05-20 15:00:00", None),
        ("1850-06-01", "2025-05-20 15:00:00", None),
    ]
    df = frame("i int, b string, at string", *[(i, b, at) for i, (b, at, _) in enumerate(cases)])
    day = dates.local_date(F.col("at").cast("timestamp_ntz"))
    assert values(df, dates.age_on(F.col("b"), day)) == [age for *_, age in cases]


def test_no_text_cell_begins_a_formula(texts):
    """Generated cells: quoted, inner quotes doubled, and an apostrophe where the first character that is no blank would compute."""
    source = random.Random(21)
    cells = ["".join(source.choices("=+-@ \t\r\n\"',;aZ9é", k=source.randint(0, 6))) for _ in range(600)]

    def plain(cell):
        first = cell.lstrip(" \t\r\n")[:1]
        return '"' + ("'" if first and first in "=+-@" else "") + cell.replace('"', '""') + '"'

    df = texts(*cells, None)
    assert values(df, text.csv_cell(F.col("x"), True)) == [*map(plain, cells), '""']
    numbers_only = df.withColumn("n", F.col("i") - 300)
    assert values(numbers_only, text.csv_cell(F.col("n"), False)) == [f'"{i - 300}"' for i in range(601)]


def test_only_plain_web_links_pass(texts):
    """Every combination of the parts of a link: web schemes, a host, and nobody's credentials."""
    schemes, seps = ("http", "https", "HTTPS", "ftp", "vbscript", ""), ("://", ":", "//")
    users, hosts, ports, rests = ("", "ana@", "ana:clave@"), ("liga.example", "a_b.org", ""), ("", ":8080"), ("", "/tabla 2", "?zona=4", "#@x")
    wanted = {}
    for scheme, sep, user, host, port, rest in itertools.product(schemes, seps, users, hosts, ports, rests):
        link = f"{scheme}{sep}{user}{host}{port}{rest}"
        web_link = scheme.lower() in ("http", "https") and sep == "://" and not user and host != ""
        wanted[f" {link} "] = link.replace(" ", "%20") if web_link else None
    df = texts(*wanted, None)
    assert values(df, web.safe_url(F.col("x"))) == [*wanted.values(), None]


def test_normalised_text(texts):
    df = texts("  C.D. Molino  Azul ", "ÑANDÚ  Ópera", "é ", None)
    assert values(df, text.normalize_text(F.col("x"))) == ["c.d. molino  azul", "nandu  opera", "e", ""]
    assert values(df, text.normalize_key(F.col("x"))) == ["c d molino azul", "nandu opera", "e", ""]
    assert values(df, text.initials(F.col("x"))) == ["CM", "ÑÓ", "É", "7M"]


def test_spanish_order(texts):
    df = texts("ópera", "ñandu", "Nube", "alvarez", "Álvarez")
    ordered = [r.x for r in df.orderBy(text.spanish(F.col("x")), "i").collect()]
    assert ordered == ["alvarez", "Álvarez", "Nube", "ñandu", "ópera"]


def test_categories(texts):
    spellings = ["Infantil", "MENORES", "cadete", "Juveniles ", "Júniors", "Mayor", "Veteranos", None]
    df = texts(*spellings)
    assert values(df, labels.category_rank(F.col("x"))) == [0, 1, 2, 3, 4, 5, 999, 999]
    assert values(df, labels.category_label(F.col("x"))) == [
        "Infantiles", "Menores", "Cadetes", "Juveniles", "Juniors", "Mayores", "Veteranos", "Categoría",
    ]


def test_ratios_are_exact_halves_up(frame):
    df = frame("i int, a bigint, b bigint", (0, 29, 20), (1, 1, 3), (2, 0, 5), (3, 5, 0), (4, 108, 2))
    assert values(df, numbers.ratio_1dp(F.col("a"), F.col("b"))) == [1.5, 0.3, 0.0, None, 54.0]


def test_numbers(texts):
    df = texts("12", " 7 ", "no-numérico", "Infinity", None)
    assert values(df, numbers.to_number(F.col("x"))) == [12.0, 7.0, 0.0, 0.0, 0.0]
    assert values(df, numbers.to_id(F.col("x"))) == [12, 7, None, None, None]


def test_freshness(frame):
    cases = [
        ("Programado", "2025-03-20", None, None, "scheduled"),
        ("Programado", "2025-03-08", None, None, "scheduled"),
        ("Programado", "2025-03-07", None, None, "result-pending"),
        ("Programado", "2024-12-30", 18, 17, "scheduled"),
        ("Programado", "07/03/2025", None, None, "scheduled"),
        ("Finalizado", "2025-02-20", 31, 29, "final"),
    ]
    df = frame("i int, s string, d string, h int, a int", *[(i, *case[:-1]) for i, case in enumerate(cases)])
    state = labels.freshness(F.col("s"), F.col("d"), F.col("h"), F.col("a"), "2025-03-08")
    assert values(df, state) == [case[-1] for case in cases]


def test_states_of_responses(frame):
    """Every status with every kind of body: what protects a resource outweighs what is missing, both outweigh the status."""
    bodies = {
        "": "", '[{"pos": 1}]': "json", "<p>tabla</p>": "", "Forbidden zone": "auth", '{"why": "invalid TOKEN"}': "auth", "page Not Found": "missing",
        "not found: missing token": "auth", "null": "",
    }
    cases = list(itertools.product((None, 199, 200, 204, 299, 300, 401, 403, 404, 502), bodies))

    def plain(status, kind):
        if status in (401, 403) or kind == "auth":
            return "auth_required"
        if status == 404 or kind == "missing":
            return "not_found"
        if status is None or not 200 <= status < 300:
            return "transport_or_server_error"
        return "public_json" if kind == "json" else "public_non_json"

    df = frame("i int, s int, b string", *[(i, s, b) for i, (s, b) in enumerate(cases)])
    assert values(df, web.response_state(F.col("s"), F.col("b"))) == [plain(s, bodies[b]) for s, b in cases]


def test_folding_is_decomposition_without_accents_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    # a hundred characters a text, each behind a letter that shows where it was
    texts = ["".join(f"{c}|" for c in chars[i : i + 100]) for i in range(0, len(chars), 100)]
    frame = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4)
    found = dict(frame.select("x", text.fold_accents(F.col("x"))).collect())
    accents = dict.fromkeys(range(0x300, 0x370))
    assert all("".join(unicodedata.normalize("NFD", c).translate(accents) + "|" for c in t[::2]) == f for t, f in found.items())


def test_folding_looks_for_single_ranges_only(spark):
    """A pattern of many ranges tries each of them on every character."""
    patterns = re.findall(r"rlike\(t, '(.*?)'\)", text.fold_accents(F.col("t"))._jc.toString())
    assert patterns and all(len(p) == len("[a-z]") for p in patterns)
