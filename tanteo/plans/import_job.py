"""Import jobs that end in a commit: what a load changes becomes visible at once, or not at all.

A store holds the league's raw tables. A run reads them in one version, computes the load, and commits the new tables and its log
as the next version. A run that died, was repeated or met another commit can simply be started again with the same number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.plans import fixture_import, match_sheets, team_sync
from tanteo.schemas import IMPORT_REVISION
from tanteo.sources.snapshots import Commit, SnapshotStore

#: Application names under which runs are counted.
FIXTURES, TEAMS, SHEETS = "fixtures", "teams", "sheets"


def open_league(store: SnapshotStore, tables: Mapping[str, DataFrame]) -> Commit:
    """Put the raw tables into an empty store, with an empty review queue if none is given."""
    empty = store.spark.createDataFrame([], IMPORT_REVISION)
    return store.commit(("open", 1), {"import_revision": empty, **tables})


def import_fixtures(
    store: SnapshotStore, number: int, batches: DataFrame, run_at: str, max_rows: int | None = None,
    source: str = "la federación", app: str = FIXTURES,
) -> Commit:
    """Check the batches, apply the accepted ones to matches and review queue, and log a verdict and counters per batch."""
    run = (app, number)
    now = store.manifest()
    if store.is_applied(run):
        return Commit(now.version, False)
    current = {name: store.open(now.tables[name]) for name in ("temporadas", "equipos", "partidos", "import_revision")}
    verdicts, result = fixture_import.import_batches(
        batches, current["temporadas"], current["equipos"], current["partidos"], current["import_revision"], run_at, source, max_rows
    )
    log = verdicts.join(result.counters, "batch_id", "left").select(
        F.lit(app).alias("app"), F.lit(number).cast("bigint").alias("run"), "*", F.lit(run_at).alias("run_at")
    )
    changed = {"partidos": result.matches, "import_revision": result.reviews}
    return store.commit(run, changed, {"import_log": log}, base=now.version)


def import_teams(store: SnapshotStore, number: int, requests: DataFrame, app: str = TEAMS) -> Commit:
    """Find or create the team of every request; teams and aliases switch together, the answers are logged."""
    run = (app, number)
    now = store.manifest()
    if store.is_applied(run):
        return Commit(now.version, False)
    current = [store.open(now.tables[name]) for name in ("temporadas", "clubes", "equipos", "club_aliases")]
    result = team_sync.sync_teams(requests, *current)
    log = result.results.select(F.lit(app).alias("app"), F.lit(number).cast("bigint").alias("run"), "*")
    return store.commit(run, {"equipos": result.teams, "club_aliases": result.aliases}, {"team_log": log}, base=now.version)


def import_sheets(
    store: SnapshotStore, number: int, sheets: DataFrame, matches: DataFrame, cards: DataFrame, players: DataFrame, rosters: DataFrame,
    app: str = SHEETS,
) -> Commit:
    """Load match sheets into ``lines``: the lines of a sheet replace those of the same match, team and player.

    ``matches``, ``cards``, ``players`` and ``rosters`` are checked tables. Players that no roster knows and sheets that fit no match,
    or several, are kept in ``sheet_players`` and ``sheet_unresolved``.
    """
    run = (app, number)
    now = store.manifest()
    if store.is_applied(run):
        return Commit(now.version, False)
    load = match_sheets.sheets_to_participations(match_sheets.parse_sheets(sheets), matches, cards, players, rosters)
    lines = match_sheets.merge_participations(store.open(now.tables["lines"]), load.participations)
    logs = {"sheet_players": load.new_players, "sheet_unresolved": load.unresolved}
    return store.commit(run, {"lines": lines}, {n: f.withColumn("run", F.lit(number).cast("bigint")) for n, f in logs.items()}, base=now.version)
