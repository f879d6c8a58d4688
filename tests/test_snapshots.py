"""Commits that switch at once, repeats that change nothing, and jobs that die half way."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tanteo.sources.snapshots import Conflict, Layout, SnapshotStore


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def numbers(spark, *values):
    return spark.createDataFrame([(v, f"v{v}") for v in values], "id bigint, name string")


def ids(store, name="t", version=None):
    return sorted(r.id for r in store.read(name, version).collect())


def test_a_commit_replaces_and_appends_and_old_versions_stay_readable(spark, store):
    assert store.versions() == [] and store.manifest().tables == {}
    store.commit(("load", 1), {"t": numbers(spark, 1, 2)}, {"log": numbers(spark, 7)})
    done = store.commit(("load", 2), {"t": store.read("t").where("id > 1").unionByName(numbers(spark, 3))}, {"log": numbers(spark, 8)})
    assert (done.version, done.applied) == (2, True)
    assert ids(store) == [2, 3] and ids(store, "log") == [7, 8]
    assert ids(store, version=1) == [1, 2] and ids(store, "log", 1) == [7]


def test_a_repeated_run_changes_nothing(spark, store):
    store.commit(("load", 5), {"t": numbers(spark, 1)})
    before = sorted(os.listdir(store.root.removeprefix("file://") + "/t"))
    for number in (5, 4):
        done = store.commit(("load", number), {"t": numbers(spark, 9)}, {"log": numbers(spark, 9)})
        assert (done.version, done.applied) == (1, False)
    assert ids(store) == [1] and sorted(os.listdir(store.root.removeprefix("file://") + "/t")) == before
    assert store.commit(("other", 1), {"t": numbers(spark, 2)}).applied and ids(store) == [2]


def test_a_job_that_dies_before_the_switch_leaves_the_old_tables(spark, store, monkeypatch):
    store.commit(("load", 1), {"t": numbers(spark, 1), "u": numbers(spark, 1)})

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "_switch", die)
        with pytest.raises(KeyboardInterrupt):
            store.commit(("load", 2), {"t": numbers(spark, 2), "u": numbers(spark, 2)})
    broken = numbers(spark, 2).withColumn("name", F.when(F.col("id") > 0, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit(("load", 2), {"t": numbers(spark, 2), "u": broken})
    assert ids(store) == [1] and ids(store, "u") == [1] and store.versions() == [1]
    # the same run again gets through, and what the dead ones wrote is cleared
    assert store.commit(("load", 2), {"t": numbers(spark, 2), "u": numbers(spark, 2)}).applied
    assert ids(store) == [2] and len(store.vacuum(keep=2)) >= 2
    assert ids(store) == [2] and ids(store, version=1) == [1]
    store.vacuum()
    assert ids(store) == [2] and store.versions() == [2]


def test_of_two_writers_one_gets_a_conflict(spark, store):
    store.commit(("load", 1), {"t": numbers(spark, 1)})
    base = store.manifest().version
    store.commit(("a", 1), {"t": store.read("t").unionByName(numbers(spark, 2))}, base=base)
    with pytest.raises(Conflict):
        store.commit(("b", 1), {"t": store.read("t", base).unionByName(numbers(spark, 3))}, base=base)
    assert ids(store) == [1, 2]


def test_buckets_and_partitions_survive_a_new_session(spark, store):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("season"), F.lit("x").alias("name"))
    layouts = {"a": Layout(("season",), ("id",), 4), "b": Layout((), ("id",), 4)}
    store.commit(("load", 1), {"a": rows, "b": rows.select("id", F.col("id").alias("other"))}, layouts=layouts)
    for frame in ("a", "b"):
        spark.sql(f"DROP TABLE {store._registered(store.manifest().tables[frame])}")
    again = SnapshotStore(spark, store.root)
    joined = again.read("a").where("season = 1").join(again.read("b").hint("merge"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(season" in plan
    assert joined.count() == 67


def test_compacting_keeps_the_rows(spark, store):
    for number in range(3):
        store.commit(("feed", number), {}, {"log": numbers(spark, number)})
    store.compact("log", ("compact", 1))
    assert ids(store, "log") == [0, 1, 2] and len(store.manifest().tables["log"].paths) == 1
