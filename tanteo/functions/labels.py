"""League vocabulary: categories, branches, team names, match states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tanteo.functions.dates import ISO_DATE
from tanteo.functions.text import normalize_text, null_if_empty

# Category order, singular spellings and labels.
CATEGORY_ORDER = ("infantiles", "menores", "cadetes", "juveniles", "juniors", "mayores")
CATEGORY_SINGULAR = {
    "infantil": "infantiles",
    "menor": "menores",
    "cadete": "cadetes",
    "juvenil": "juveniles",
    "junior": "juniors",
    "mayor": "mayores",
}
UNKNOWN_RANK = 999
# Labels of branches, states and roster positions.
BRANCH_LABELS = {"M": "Masculino", "F": "Femenino"}
FINISHED, SCHEDULED = "Finalizado", "Programado"
POSITIONS = ("Arquero", "Extremo", "Lateral", "Central", "Pivote", "Sin posición")
NO_POSITION = "Sin posición"


def _lookup(key: Column, pairs: dict[str, object]) -> Column:
    table = F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])
    return F.try_element_at(table, key)


def _category_key(category: Column) -> Column:
    return F.regexp_replace(normalize_text(category), "[^a-z]", "")


def category_rank(category: Column) -> Column:
    ranks = {name: rank for rank, name in enumerate(CATEGORY_ORDER)}
    ranks |= {singular: ranks[name] for singular, name in CATEGORY_SINGULAR.items()}
    return F.coalesce(_lookup(_category_key(category), ranks), F.lit(UNKNOWN_RANK))


def category_label(category: Column) -> Column:
    labels = {name: name.capitalize() for name in CATEGORY_ORDER}
    labels |= {singular: labels[name] for singular, name in CATEGORY_SINGULAR.items()}
    return F.coalesce(_lookup(_category_key(category), labels), null_if_empty(category), F.lit("Categoría"))


def branch_label(branch: Column, missing: str = "Rama") -> Column:
    return F.coalesce(_lookup(branch, BRANCH_LABELS), null_if_empty(branch), F.lit(missing))


def competition_label(category: Column, division: Column, branch: Column) -> Column:
    """Category, division and branch joined by dots, empty parts left out."""
    parts = [null_if_empty(category), null_if_empty(division), null_if_empty(branch_label(branch, ""))]
    return F.concat_ws(" · ", *parts)


def team_code(code: Column) -> Column:
    return F.coalesce(null_if_empty(F.upper(F.trim(code))), F.lit("A"))


def team_name(club_name: Column, federation_name: Column, code: Column, compact: bool = False) -> Column:
    """Club name, else the federation's own; teams other than A carry their letter."""
    base = F.coalesce(null_if_empty(club_name), null_if_empty(federation_name), F.lit("Equipo"))
    suffix = " " if compact else " · Equipo "
    return F.when(team_code(code) == "A", base).otherwise(F.concat(base, F.lit(suffix), team_code(code)))


def is_finished(state: Column, home_score: Column, away_score: Column) -> Column:
    """Declared final, or both scores present on a match not declared as scheduled."""
    declared = F.lower(F.coalesce(state, F.lit("")))
    scored = null_if_empty(home_score).isNotNull() & null_if_empty(away_score).isNotNull()
    return declared.isin("finalizado", "final") | (scored & (declared != "programado"))


def freshness(status: Column, date: Column, home_score: Column, away_score: Column, today: str) -> Column:
    """Final, result pending (unscored and before ``today``) or scheduled."""
    day = F.coalesce(date.cast("string"), F.lit(""))
    unscored = home_score.isNull() | away_score.isNull()
    pending = unscored & day.rlike(ISO_DATE) & F.lit(today).rlike(ISO_DATE) & (day < F.lit(today))
    return F.when(status == FINISHED, "final").when(pending, "result-pending").otherwise("scheduled")


def is_top_division(category: Column, division: Column) -> Column:
    """Senior honour league, never its silver tier."""
    name = normalize_text(division)
    honour = name.contains("liga") & name.contains("honor") & name.contains("hipotecario")
    return _is_senior_gold(category, name) & (name.rlike(r"(^|\s)lh[cd](\s|$)") | honour)


def is_any_honour_division(category: Column, division: Column) -> Column:
    """Looser rule used when a branch has no team in the top division."""
    name = normalize_text(division)
    return _is_senior_gold(category, name) & name.contains("honor")


def _is_senior_gold(category: Column, division_key: Column) -> Column:
    return (normalize_text(category) == "mayores") & ~division_key.contains("plata")
