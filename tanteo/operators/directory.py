"""Summaries, competition directory, entity lookup, search and context resolution."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions import labels
from tanteo.functions.numbers import ratio_1dp
from tanteo.functions.text import normalize_text, null_if_empty, spanish
from tanteo.operators.ranking import packed, packed_second, ranked
from tanteo.operators.scope import active_teams, matches_in_scope, within_one_scope
from tanteo.operators.silver import scope_key
from tanteo.session import cut

COMPETITION = ("branch", "category", "division")


def _counts(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames of counters into one row without joining them."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in merged.columns])


def _match_counts(matches: DataFrame) -> DataFrame:
    finished = F.col("status") == labels.FINISHED
    goals = F.coalesce(F.col("home_score"), F.lit(0)) + F.coalesce(F.col("away_score"), F.lit(0))
    return matches.agg(
        F.count("*").alias("matches"),
        F.count_if(finished).alias("finished"),
        F.sum(F.when(finished, goals)).alias("goals"),
    )


def _with_average(summary: DataFrame) -> DataFrame:
    return summary.withColumn("avg_goals", ratio_1dp(F.col("goals"), F.col("finished")))


def scope_summary(teams: DataFrame, rosters: DataFrame, matches: DataFrame) -> DataFrame:
    """Teams, memberships, matches, finished, goals and average of the current scope."""
    members = rosters.join(teams.select("team_id"), "team_id", "left_semi")
    return _with_average(
        _counts(
            teams.agg(F.count("*").alias("clubs")),
            members.agg(F.count("*").alias("players")),
            _match_counts(matches_in_scope(matches, teams)),
        )
    )


def global_summary(raw_clubs: DataFrame, raw_players: DataFrame, raw_matches: DataFrame) -> DataFrame:
    """The same figures over the whole base, whatever the scope."""
    home, away = F.col("goles_local"), F.col("goles_visitante")
    status = F.when(labels.is_finished(F.col("estado"), home, away), labels.FINISHED)
    matches = raw_matches.select(status.alias("status"), home.alias("home_score"), away.alias("away_score"))
    return _with_average(
        _counts(
            raw_clubs.agg(F.count("*").alias("clubs")),
            raw_players.agg(F.count("*").alias("players")),
            _match_counts(matches),
        )
    )


def dashboard_health(summary: DataFrame) -> DataFrame:
    scheduled = F.greatest(F.lit(0), F.col("matches") - F.col("finished"))
    return summary.select("matches", "finished", scheduled.cast("bigint").alias("scheduled"))


def competition_directory(teams: DataFrame, matches: DataFrame) -> DataFrame:
    """Teams, matches and finished matches of each competition, ending with a total row."""
    active = active_teams(teams)
    # Grouped by the columns themselves: a text is no state of a hash aggregate.
    team_counts = active.groupBy(scope_key().alias("scope"), *COMPETITION).agg(F.count("*").alias("teams"))
    match_counts = (
        within_one_scope(matches_in_scope(matches, active))
        .groupBy(F.col("home_scope").alias("scope"))
        .agg(F.count("*").alias("matches"), F.count_if(F.col("status") == labels.FINISHED).alias("finished"))
    )
    # One row per competition on both sides.
    columns = ("teams", "matches", "finished")
    per_competition = (
        team_counts.join(match_counts, "scope", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in columns})
        .drop("scope")
    )
    total = per_competition.agg(F.count("*").alias("competitions"), *[F.sum(c).alias(c) for c in columns])
    per_competition = per_competition.withColumns(
        {"competitions": F.lit(1).cast("bigint"), "rank": labels.category_rank(F.col("category"))}
    )
    return per_competition.unionByName(total, allowMissingColumns=True)


def directory_order() -> list[Column]:
    return [F.asc_nulls_last("branch"), F.asc("rank"), spanish(F.col("division")).asc()]


def team_switcher_order() -> list[Column]:
    """Branch, category, division, team letter."""
    return [
        F.asc("branch"), labels.category_rank(F.col("category")).asc(), spanish(F.col("division")).asc(),
        F.asc("team_code"), F.asc("team_id"),
    ]


def team_switcher(teams: DataFrame) -> DataFrame:
    """Active teams of each club in the order they are offered."""
    return ranked(active_teams(teams), ["club_id"], team_switcher_order())


def competition_bar(teams: DataFrame, matches: DataFrame) -> DataFrame:
    """Teams, matches and finished matches of the table on screen."""
    counted = _match_counts(matches_in_scope(matches, teams)).select("matches", "finished")
    return _counts(teams.agg(F.count("*").alias("teams")), counted)


def search_clubs(table: DataFrame, term: str = "", sort: str = "points") -> DataFrame:
    """Teams of the table whose name contains the term."""
    if term:
        table = table.where(normalize_text(F.col("name")).contains(normalize_text(F.lit(term))))
    return table.orderBy(*club_order(sort))


def club_order(sort: str) -> list[Column]:
    name = spanish(F.col("name")).asc()
    keys = {
        "points": [F.desc("points"), F.desc("gd"), name],
        "name": [name],
        "goals": [F.desc("gf")],
        "balance": [F.desc("gd")],
    }
    return [*keys[sort], F.asc("team_id")]


def bar_share(table: DataFrame) -> DataFrame:
    """Goals-for of each team as a rounded percentage of the best attack."""
    best = table.agg(F.greatest(F.lit(1), F.max("gf"))).scalar()
    share = F.floor((F.col("gf") * 200 + best) / (best * 2))
    return table.withColumn("bar", share.cast("bigint"))


def entity_lookup(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Rows of the requested entities inside the scope of ``df``."""
    return df.where(F.col(key).isin(*ids))


def search_index(clubs: DataFrame, players: DataFrame, rosters: DataFrame, cards: DataFrame) -> DataFrame:
    """Clubs and (player, team) memberships with the text they are found by."""
    club_rows = clubs.select(
        F.lit("club").alias("type"),
        F.col("club_id").alias("id"),
        F.lit(None).cast("bigint").alias("team_id"),
        F.col("club_name").alias("name"),
        F.lit("Club").alias("context"),
        normalize_text(F.col("club_name")).alias("normalized"),
    )
    club = F.coalesce(null_if_empty(F.col("club_name")), null_if_empty(F.col("federation_name")), F.lit("Sin club"))
    where = F.concat_ws(
        " · ", club, labels.competition_label(F.col("category"), F.col("division"), F.col("branch"))
    )
    contexts = cards.select("team_id", where.alias("context"))
    memberships = rosters.select("player_id", "team_id").distinct().join(contexts, "team_id")
    player_rows = players.select("player_id", "player_name").join(memberships, "player_id", "left")
    text = F.concat_ws(" ", "player_name", "context")
    return club_rows.unionByName(
        player_rows.select(
            F.lit("player").alias("type"),
            F.col("player_id").alias("id"),
            "team_id",
            F.col("player_name").alias("name"),
            F.coalesce("context", F.lit("Jugador")).alias("context"),
            normalize_text(text).alias("normalized"),
        )
    )


def _positive(value: Column) -> Column:
    number = F.trim(value.cast("string")).try_cast("bigint")
    return F.when(number > 0, number)


class Context(NamedTuple):
    """Decisions, one row per request; and the choices of each entity, stored once: an ambiguous decision names its set in
    ``choice_set``, whatever the number of requests that share it."""

    decisions: DataFrame
    choice_sets: DataFrame


def choices(context: Context) -> DataFrame:
    """The choices of every ambiguous request: the sets joined to the requests that name them."""
    asked = context.decisions.where("status = 'ambiguous'").select("request_id", "choice_set")
    return asked.join(context.choice_sets, "choice_set").drop("choice_set")


def resolve_player_context(requests: DataFrame, memberships: DataFrame, visible: DataFrame) -> Context:
    """Team each request (request_id, player_id, requested_team_id) refers to; the choices of a player are the teams on screen, or all
    if none is.

    Memberships are read once, into one row per player and team with a mark for those on screen; they are counted per player, never
    gathered, so a player on many rosters stays spread over the cluster.
    """
    asked = requests.select(
        "request_id", _positive(F.col("player_id")).alias("player_id"),
        _positive(F.col("requested_team_id")).alias("requested_team_id"),
    )
    sources = memberships.select("player_id", "team_id", F.lit(True).alias("member"), F.lit(False).alias("on_screen")).unionByName(
        visible.select("player_id", "team_id", F.lit(False).alias("member"), F.lit(True).alias("on_screen")))
    marked = sources.where("player_id > 0 and team_id > 0").groupBy("player_id", "team_id").agg(
        F.max("member").alias("member"), F.max("on_screen").alias("on_screen")
    )
    teams = cut(marked.where("member").drop("member"))
    counts = teams.groupBy("player_id").agg(
        F.count("*").alias("total"),
        F.count_if("on_screen").alias("shown"),
        F.min("team_id").alias("only_team"),
        F.min(F.when(F.col("on_screen"), F.col("team_id"))).alias("only_shown"),
    )
    requested = teams.select("player_id", F.col("team_id").alias("requested_team_id"), F.lit(True).alias("belongs"))
    joined = asked.join(counts, "player_id", "left").join(requested, ["player_id", "requested_team_id"], "left")
    asks_team = F.col("requested_team_id").isNotNull()
    status = (
        F.when(F.col("player_id").isNull(), "missing")
        .when(asks_team & F.col("belongs"), "team")
        .when(asks_team, "invalid-team")
        .when(F.col("shown") == 1, "current")
        .when(F.col("shown") > 1, "ambiguous")
        .when(F.col("total") == 1, "team")
        .when(F.col("total") > 1, "ambiguous")
        .otherwise("missing")
    )
    team = (
        F.when(F.col("status") == "current", F.col("only_shown"))
        .when((F.col("status") == "team") & asks_team, F.col("requested_team_id"))
        .when(F.col("status") == "team", F.col("only_team"))
    )
    decided = joined.withColumn("status", status).select(
        "request_id", "player_id", "status", team.alias("team_id"),
        F.when(F.col("status") == "ambiguous", F.col("player_id")).alias("choice_set"),
    )
    seen = counts.select("player_id", F.col("shown") > 0)
    sets = teams.join(seen.toDF("player_id", "any_shown"), "player_id").where("on_screen OR NOT any_shown")
    return Context(decided, sets.select(F.col("player_id").alias("choice_set"), "player_id", "team_id"))


def context_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("category", "division", "branch")])


def resolve_scoped_context(requests: DataFrame, memberships: DataFrame) -> Context:
    """Competition each request (request_id, entity_id, requested_team_id, current_present) refers to.

    ``memberships`` holds (entity_id, team_id, context_key, seq); ``seq`` is not negative and differs between the rows of an entity. The
    lowest one stands for a context. The choices of an entity are one row per possible context.
    """
    asked = requests.select(
        "request_id", _positive(F.col("entity_id")).alias("entity_id"),
        _positive(F.col("requested_team_id")).alias("requested_team_id"),
        F.coalesce("current_present", F.lit(False)).alias("current_present"),
    )
    valid = memberships.where((F.col("team_id") > 0) & (F.coalesce("context_key", F.lit("")) != ""))
    firsts = valid.groupBy("entity_id", "context_key").agg(F.min(packed(F.col("seq"), F.col("team_id"))).alias("first"))
    contexts = cut(firsts)
    counts = contexts.groupBy("entity_id").agg(F.count("*").alias("contexts"), F.min("first").alias("first"))
    lead = counts.join(contexts, ["entity_id", "first"]).select(
        "entity_id", "contexts", packed_second(F.col("first")).alias("lead_team"), F.col("context_key").alias("lead_key"))
    own = valid.groupBy("entity_id", F.col("team_id").alias("requested_team_id")).agg(F.min("seq").alias("seq"))
    own = own.join(valid.select("entity_id", "seq", F.col("context_key").alias("own_key")), ["entity_id", "seq"]).drop("seq")
    joined = asked.join(lead, "entity_id", "left").join(own, ["entity_id", "requested_team_id"], "left")
    asks_team = F.col("requested_team_id").isNotNull()
    status = (
        F.when(F.col("entity_id").isNull(), "invalid")
        .when(F.col("contexts").isNull(), "missing")
        .when(asks_team & F.col("own_key").isNull(), "invalid-team")
        .when(asks_team, "team")
        .when(F.col("current_present"), "current")
        .when(F.col("contexts") == 1, "team")
        .otherwise("ambiguous")
    )
    by_request = (F.col("status") == "team") & asks_team
    by_context = (F.col("status") == "team") & ~asks_team
    decided = joined.withColumn("status", status).select(
        "request_id",
        "entity_id",
        "status",
        F.when(by_context, F.col("lead_team"))
        .when(by_request | (F.col("status") == "invalid-team"), F.col("requested_team_id"))
        .alias("team_id"),
        F.when(by_context, F.col("lead_key")).when(by_request, F.col("own_key")).alias("context_key"),
        F.when(F.col("status") == "ambiguous", F.col("entity_id")).alias("choice_set"),
    )
    sets = contexts.select(F.col("entity_id").alias("choice_set"), "entity_id", packed_second(F.col("first")).alias("team_id"), "context_key")
    return Context(decided, sets)
