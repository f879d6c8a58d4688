"""Row positions that stay distributed whatever share of the rows one group holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanteo.session import cut


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must end in a unique key.

    The rows are range-partitioned by group and order into the session's shuffle partitions, sorted and numbered inside each slice as
    they are written; a slice's offset is the number of rows that its groups have in earlier slices. The slices are written once,
    because both the offsets and the positions read them and a second range partitioning could draw other bounds.
    """
    keys = [F.col(c) for c in by]
    sliced = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The number of the slice is above the 33 bits of the row's place in it.
    placed = cut(sliced.withColumn("_at", F.monotonically_increasing_id())).withColumn("_slice", F.shiftright("_at", 33))
    per_slice = placed.groupBy(*by, "_slice").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # One row per (slice, group) pair that meets: a group has at most as many as there are shuffle partitions.
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    if not by:
        # A row per slice.
        offsets = F.broadcast(offsets)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] + [F.col("_slice") == F.col("_s")]
    positioned = placed.join(offsets, reduce(lambda a, b: a & b, same))
    return positioned.withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint")).select(*df.columns, name)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows of each group; Spark trims every group before the shuffle, so hot groups stay small."""
    window = Window.partitionBy(*[F.col(c) for c in by]).orderBy(*order)
    numbered = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return numbered.withColumn(name, F.col(name).cast("bigint"))


def top_overall(df: DataFrame, order: Sequence[Column], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows of the whole frame with their position; only ``k`` rows reach the last step."""
    kept = df.orderBy(*order).limit(k)
    position = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return kept.withColumn(name, position.cast("bigint"))


def packed(first: Column, second: Column) -> Column:
    """Two non-negative 64-bit numbers as one: its minimum is that of the first, with the second beside it.

    Spark keeps such a number in a hash aggregate; for a struct it would sort.
    """
    return first.cast("decimal(19,0)") * F.expr(_ABOVE) + second.cast("decimal(19,0)")


def packed_first(number: Column) -> Column:
    return F.floor(number / F.expr(_ABOVE)).cast("bigint")


def packed_second(number: Column) -> Column:
    return (number % F.expr(_ABOVE)).cast("bigint")


def row_mark(seq: Column, *columns: str) -> Column:
    """``seq`` and a digest of the row as one number, by which the row can be found again; rows that share it are equal."""
    return packed(seq, F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1)))


_ABOVE = "cast('10000000000000000000' AS decimal(20,0))"
