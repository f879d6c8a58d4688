"""Which teams, matches and lines a question is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanteo.functions import labels
from tanteo.functions.text import is_blank, spanish


def scope_teams(
    teams: DataFrame, category: str | None = None, division: str | None = None, branch: str | None = None
) -> DataFrame:
    """Teams of a competition; an empty filter means any."""
    for column, wanted in (("category", category), ("division", division), ("branch", branch)):
        if wanted:
            teams = teams.where(F.col(column) == wanted)
    return teams


def active_teams(teams: DataFrame) -> DataFrame:
    """Teams not marked as inactive; an unknown flag counts as active."""
    return teams.where(F.coalesce(F.col("active"), F.lit(True)))


def matches_in_scope(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Matches whose both teams are in ``teams``."""
    ids = teams.select("team_id")
    home, away = (ids.withColumnRenamed("team_id", f"{side}_team_id") for side in ("home", "away"))
    return matches.join(home, "home_team_id", "left_semi").join(away, "away_team_id", "left_semi")


def within_one_scope(matches: DataFrame) -> DataFrame:
    """Matches between two teams of the same competition."""
    return matches.where(F.col("home_scope") == F.col("away_scope"))


def top_division_teams(teams: DataFrame) -> DataFrame:
    """Top-division teams of each branch; a branch without any falls back to its other honour divisions."""
    top = labels.is_top_division(F.col("category"), F.col("division"))
    honour = labels.is_any_honour_division(F.col("category"), F.col("division"))
    branches = teams.where(top).select(F.col("branch").alias("_branch")).distinct()
    direct = teams.where(top)
    fallback = teams.where(honour).join(branches, F.col("branch").eqNullSafe(F.col("_branch")), "left_anti")
    return direct.unionByName(fallback)


LEVELS = (("branch", "rama"), ("category", "categoria"), ("division", "division"))


def competition_tree(teams: DataFrame) -> DataFrame:
    """Choices of every level under the choices above it: (level, above, value, rank, first), one row per path of
    (branch, category, division), whatever the number of teams. ``above`` lists the values chosen above; blank ones are empty there.
    """
    named = [F.when(~is_blank(F.col(c)), F.col(c)) for c, _ in LEVELS]
    paths = teams.select(*[v.alias(c) for v, (c, _) in zip(named, LEVELS, strict=True)]).distinct()

    def step(depth: int) -> Column:
        column, level = LEVELS[depth]
        above = F.array(*[F.coalesce(F.col(c), F.lit("")) for c, _ in LEVELS[:depth]]).cast("array<string>")
        rank = labels.category_rank(F.col(column)) if column == "category" else F.lit(0)
        return F.struct(F.lit(level).alias("level"), above.alias("above"), F.col(column).alias("value"), rank.cast("int").alias("rank"))

    choices = paths.select(F.inline(F.array(*[step(d) for d in range(len(LEVELS))]))).where("value IS NOT NULL").distinct()
    order = [F.asc("rank"), spanish(F.col("value")).asc(), F.asc("value")]
    leading = Window.partitionBy("level", "above").orderBy(*order)
    return choices.withColumn("first", F.row_number().over(leading) == 1)


def resolve_competitions(tree: DataFrame, requests: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The competition each request (request_id, rama, categoria, division) lands on: at each level what it asks for if that is a
    choice there, else the default, else the first choice, else nothing. All requests are resolved in one plan, by equi-joins with
    the tree.
    """
    found = requests.select("request_id", *[F.col(level).alias(f"_{level}") for _, level in LEVELS])
    chosen: list[str] = []
    for _, level in LEVELS:
        here = tree.where(F.col("level") == level)
        standing = F.max(F.when(F.col("value") == F.lit(defaults.get(level)).cast("string"), F.col("value")))
        fallback = F.coalesce(standing, F.max(F.when(F.col("first"), F.col("value"))))
        known = here.select(F.col("above").alias("_above"), F.col("value").alias("_asked"), F.lit(True).alias("_known"))
        found = found.withColumns({"_above": F.array(*[F.col(c) for c in chosen]).cast("array<string>"), "_asked": F.col(f"_{level}")})
        found = found.join(known, ["_above", "_asked"], "left")
        if chosen:
            found = found.join(here.groupBy(F.col("above").alias("_above")).agg(fallback.alias("_fallback")), "_above", "left")
        else:
            # The first level has one list of choices, so one fallback for all requests.
            found = found.withColumn("_fallback", here.agg(fallback.alias("value")).scalar())
        value = F.coalesce(F.when(F.col("_known"), F.col(f"_{level}")), F.col("_fallback"), F.lit(""))
        found = found.withColumn(level, value).drop("_above", "_asked", "_known", "_fallback", f"_{level}")
        chosen.append(level)
    return found


def competition_options(tree: DataFrame, resolved: DataFrame) -> DataFrame:
    """The choices each resolved request is shown: (request_id, level, value, rank, selected). The choices themselves are kept once,
    in the tree; this is the view on it that a screen reads."""
    names = [level for _, level in LEVELS]
    shown = resolved.select("request_id", F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.array(*names[:d]).cast("array<string>").alias("above"), F.col(level).alias("chosen"))
        for d, level in enumerate(names)
    ])))
    found = shown.join(tree, ["level", "above"])
    return found.select("request_id", "level", "value", "rank", (F.col("value") == F.col("chosen")).alias("selected"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values."""
    return df.where(~is_blank(F.col(column))).select(column).distinct()
