"""Checked tables of the test league: stored once per application, read by every query."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, ShortType

from tanteo.operators import players as player_ops
from tanteo.operators import directory, search, standings
from tanteo.operators.scope import within_one_scope
from tanteo.session import cut, scratch_dir
from tanteo.sources.silver_store import TABLES, SilverStore
from tanteo.sources.snapshots import SnapshotStore
from tanteo.sources.star_league import SEASON_ID, StarLeague


_STORES: dict[tuple[str, str], SilverStore] = {}


class Silver(StarLeague):
    """Typed, checked tables over the test league."""

    @cached_property
    def kept(self) -> SilverStore:
        """The store of this folder in this application."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _STORES:
            name = hashlib.md5("|".join(key).encode(), usedforsecurity=False).hexdigest()
            _STORES[key] = SilverStore(self.spark, f"{scratch_dir(self.spark).rstrip('/')}/silver-{name}")
        return _STORES[key]

    @cached_property
    def store(self) -> SilverStore:
        """The store with all checked tables of this folder."""
        self.kept.ensure(self.raw, *TABLES)
        return self.kept

    @cached_property
    def indexed(self) -> SnapshotStore:
        """The store with the search index, built by the first search of an application."""
        search.build(self.kept.snapshots, directory.search_index(self.clubs, self.players, self.rosters, self.cards))
        return self.kept.snapshots

    def checked(self, name: str) -> DataFrame:
        """A checked table, stored by the first query of an application that asks for it: a query pays for the tables it reads."""
        self.kept.ensure(self.raw, "cards" if name == "teams" else name)
        return self.kept.table(name, SEASON_ID)

    def passing(self, name: str) -> DataFrame:
        """A checked table for a query that reads few of its columns, once; matches without their scores."""
        return self.kept.passing({**self.raw, "partidos": self.calendario}, name, SEASON_ID).drop("season_id")

    @cached_property
    def clubs(self) -> DataFrame:
        return self.checked("clubs")

    @cached_property
    def teams(self) -> DataFrame:
        return self.checked("teams")

    @cached_property
    def cards(self) -> DataFrame:
        return self.checked("cards")

    @cached_property
    def players(self) -> DataFrame:
        return self.checked("players")

    @cached_property
    def rosters(self) -> DataFrame:
        return self.checked("rosters").drop("season_id")

    @cached_property
    def matches(self) -> DataFrame:
        return self.checked("matches").drop("season_id")

    @cached_property
    def scoped(self) -> DataFrame:
        return within_one_scope(self.matches)

    @cached_property
    def lines(self) -> DataFrame:
        return self.checked("lines").drop("season_id")

    @cached_property
    def stats(self) -> DataFrame:
        return player_ops.player_team_stats(self.lines)

    @cached_property
    def sheet(self) -> DataFrame:
        return player_ops.player_sheet(self.rosters, self.players, self.cards, self.stats)

    @cached_property
    def results(self) -> DataFrame:
        return standings.result_table(self.cards, self.scoped)

    @cached_property
    def team_rows(self) -> DataFrame:
        return standings.team_table(self.cards, self.scoped, self.rosters, self.stats)

    @cached_property
    def played(self) -> DataFrame:
        """Finished matches as stored: the table and the mini-tables both read them."""
        columns = ("match_id", "home_team_id", "away_team_id", "home_score", "away_score", "status")
        return cut(standings.finished_matches(self.scoped).select(*columns))

    @cached_property
    def standings(self) -> DataFrame:
        return standings.standings(standings.result_table(self.cards, self.played), self.played)


def load(spark: SparkSession, folder: str) -> Silver:
    return Silver(spark, folder)


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: whole numbers as bigint, dates and lists as text."""

    def column(field):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (IntegerType, ShortType)):
            value = value.cast("bigint")
        elif isinstance(field.dataType, DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, ArrayType):
            value = F.array_join(value, ",")
        return value.alias(field.name)

    return df.select(*[column(f) for f in df.schema])
