"""Totals kept as partial states: a change of one slice costs that slice, not the table.

Rows belong to a season and, inside it, to a slice (a round, a day). For each slice the sums of every key are stored, and a digest of
the rows they come from. ``apply`` takes the present rows of some slices, finds the slices whose digest changed, and replaces their
sums; a season without a changed slice keeps its files. ``totals`` adds up the stored sums and reads no row again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.functions.numbers import result_points
from tanteo.operators import standings
from tanteo.session import cut
from tanteo.sources.snapshots import Commit, Entry, Layout, Manifest, SnapshotStore

SLICE = ("season_id", "slice")
_DIGEST = "rows bigint, digest decimal(38,0)"


class MergeableTotals:
    """Sums of ``measures`` per ``keys`` in a snapshot store, under ``name``.

    Measures are aggregates that add up over slices: sums, counts, and counts of different values that no two slices share.
    """

    def __init__(self, store: SnapshotStore, name: str, keys: Sequence[str], measures: Mapping[str, Column]) -> None:
        self.store, self.name, self.keys, self.measures = store, name, list(keys), dict(measures)

    def _season(self, season: int) -> str:
        return f"{self.name}@{season}"

    def apply(self, run: tuple[str, int], rows: DataFrame, emptied: DataFrame | None = None) -> tuple[Commit, DataFrame]:
        """Bring the slices of ``rows`` up to date, which hold every present row of each slice that they name; slices that lost all
        their rows are named in ``emptied`` (season_id, slice). Returns the commit and the slices that had changed."""
        now = self.store.manifest()
        known = self._digests(now)
        if self.store.is_applied(run):
            return Commit(now.version, False), known.select(*SLICE).limit(0)
        # A sum of row hashes depends neither on the order of the rows nor on how they are spread; the count tells copies apart.
        found = rows.groupBy(*SLICE).agg(
            F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("digest")
        )
        if emptied is not None:
            gone = emptied.select(*SLICE, F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("decimal(38,0)").alias("digest"))
            found = found.unionByName(gone)
        before = known.select(*SLICE, F.struct("rows", "digest").alias("before"))
        changed = cut(found.join(before, list(SLICE), "left").where(~F.struct("rows", "digest").eqNullSafe(F.col("before"))).drop("before"))
        # One row per season: there are few of them.
        seasons = [r[0] for r in changed.select("season_id").distinct().collect()]
        # Dealt by the first key, as the sums are stored: adding them up, now and in ``totals``, then moves no row again.
        layout = Layout((), (self.keys[0],), int(self.store.spark.conf.get("spark.sql.shuffle.partitions")))
        present = rows.join(changed.select(*SLICE), list(SLICE), "left_semi").repartition(layout.buckets, self.keys[0])
        fresh = present.groupBy(*SLICE, *self.keys).agg(*[m.cast("bigint").alias(n) for n, m in self.measures.items()])
        if len(seasons) > 1:
            fresh = cut(fresh)
        entries: dict[str, Entry] = {}
        for season in seasons:
            name = self._season(season)
            state = fresh.where(F.col("season_id") == season)
            if name in now.tables:
                kept = self.store.open(now.tables[name]).join(changed.select(*SLICE), list(SLICE), "left_anti")
                state = kept.unionByName(state)
            entries[name] = self.store.stage(name, state, layout)
        digests = known.join(changed.select(*SLICE), list(SLICE), "left_anti").unionByName(changed.where("rows > 0"))
        entries[f"{self.name}-digests"] = self.store.stage(f"{self.name}-digests", digests)
        return self.store.publish(run, entries, now), changed.select(*SLICE)

    def _digests(self, now: Manifest) -> DataFrame:
        name = f"{self.name}-digests"
        if name in now.tables:
            return self.store.open(now.tables[name])
        return self.store.spark.createDataFrame([], f"season_id bigint, slice string, {_DIGEST}")

    def totals(self, season_id: int | None = None) -> DataFrame:
        """The sums of each season and key, over all slices."""
        tables = self.store.manifest().tables
        wanted = [n for n in tables if n.startswith(f"{self.name}@") and season_id in (None, int(n.rsplit("@", 1)[1]))]
        if not wanted:
            raise KeyError(f"{self.name} holds no season {season_id}" if season_id is not None else f"{self.name} is empty")
        states = reduce(DataFrame.unionByName, [self.store.open(tables[n]) for n in wanted])
        return states.groupBy("season_id", *self.keys).agg(*[F.sum(n).alias(n) for n in self.measures])


def slices(matches: DataFrame) -> DataFrame:
    """Matches with their slice: the round, or one of its own for matches without."""
    return matches.withColumn("slice", F.coalesce(F.col("round").cast("string"), F.lit("")))


def standings_totals(store: SnapshotStore, name: str = "standings_state") -> MergeableTotals:
    """Results of each team; its rows come from ``standings_rows``."""
    own, opp = F.col("own"), F.col("opp")
    return MergeableTotals(store, name, ["team_id"], {
        "played": F.count("*"), "won": F.count_if(own > opp), "drawn": F.count_if(own == opp), "lost": F.count_if(own < opp),
        "gf": F.sum(own), "ga": F.sum(opp), "points": F.sum(result_points(own, opp)),
    })


def standings_rows(matches: DataFrame) -> DataFrame:
    """Both sides of every finished match of ``matches`` (with ``season_id`` and ``round``)."""
    return standings.match_sides(standings.finished_matches(slices(matches)), *SLICE, "match_id")


def player_totals(store: SnapshotStore, name: str = "player_state") -> MergeableTotals:
    """Statistics of each player and team; its rows come from ``player_rows``. Metrics never recorded stay null."""
    sums = {c: F.sum(c) for c in ("goals", "two_min", "yellow", "red", "assists", "shots", "saves")}
    return MergeableTotals(store, name, ["player_id", "team_id"], {"matches_played": F.countDistinct("match_id"), **sums})


def player_rows(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Player lines with the slice of their match; a match is in one slice, so its lines are counted in one."""
    return lines.drop(*SLICE).join(slices(matches).select("match_id", *SLICE), "match_id")
