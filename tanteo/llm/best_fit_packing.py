"""Best-fit packing after a Martello-Toth dominance reduction, on counts of lengths.

A piece is 1 to ``capacity`` tokens long, so the instance is a histogram of at most ``capacity`` counts, however many documents
there are. The driver gets that histogram, permanently fixes sets of pieces that dominate every other set with the same largest
piece, packs the rest best-fit decreasing (many equal sequences at once) and returns ranges: the pieces of a length with ranks
from a to b go to these sequences at this offset. Spark ranks the pieces of each length and looks their ranges up.

Ranks of one length are counted over hash buckets, so a length that a third of all pieces share is no task of its own.

A null or empty text is one piece, the end id alone. Repeated rows are packed one by one. Only the id and text columns are read;
other columns are left out. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanteo.llm.store import stored
from tanteo.llm.text import chunks
from tanteo.llm.tokens import default_vocabulary, encoder, pieces

CAPACITY = 2048
END_ID = 0

#: A pattern: runs of (length, offset, pieces in a row), and in how many sequences it is used.
Run = tuple[int, int, int]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, its end id included."""
    path = vocabulary or default_vocabulary()
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, made, ids = [], [], []
                for row, content in enumerate(part.column("text").to_pylist()):
                    whole = np.append(encode(content), np.uint32(END_ID)).astype("<u4")
                    for n, (start, length) in enumerate(pieces(len(whole), capacity)):
                        cut = whole[start : start + length]
                        rows.append(row)
                        made.append((n, start, length, zlib.crc32(cut.tobytes())))
                        if with_ids:
                            ids.append(cut.astype(np.int32))
                n, start, length, crc = zip(*made, strict=True)
                out = [part.column("doc_id").take(pa.array(rows)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[Run], int]], dict[int, int]]:
    """Sets fixed by dominance, each with its number of uses, and the counts that are left.

    For a piece j, with k the longest other piece that fits beside it, {j, k} dominates all other sets with j if
    * nothing else fits ({j} alone), or j + k fills the sequence, or
    * no two other pieces fit beside j together, or
    * no three do, and no two that do are longer together than k.
    """
    left = {length: n for length, n in counts.items() if n}
    fixed: list[tuple[list[Run], int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                others = sorted(length for length, n in left.items() if n > (length == j))
                room = capacity - j
                at = bisect_left(others, room + 1)
                if not at:
                    fixed.append(([(j, 0, 1)], left.pop(j)))
                    changed = True
                    continue
                k = others[at - 1]
                least = []
                for length in others[:3]:
                    least += [length] * min(3, left[length] - (length == j))
                pair_fits, triple_fits = len(least) > 1 and sum(least[:2]) <= room, len(least) > 2 and sum(least[:3]) <= room
                if k != room and pair_fits and (triple_fits or _longest_pair(others, left, j, room) > k):
                    break
                times = left[j] // 2 if j == k else min(left[j], left[k])
                fixed.append(([(j, 0, 1), (k, j, 1)], times))
                for length in (j, k):
                    left[length] -= times
                    if not left[length]:
                        del left[length]
                changed = True
    return fixed, left


def _longest_pair(lengths: list[int], left: dict[int, int], j: int, room: int) -> int:
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room or (low == high and left[lengths[low]] - (lengths[low] == j) < 2):
            high -= 1
            continue
        best, low = max(best, total), low + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[Run], int]]:
    """Best-fit decreasing; sequences with the same content are one pattern with a number of uses."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[list[Run], int]]] = {}

    def keep(runs: list[Run], uses: int, room: int) -> None:
        if uses:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((runs, uses))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, runs, uses = capacity, [], n
            else:
                room = rooms[at]
                runs, uses = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = min(room // length, n)
            filled = min(uses, n // each)
            keep([*runs, (length, capacity - room, each)], filled, room - each * length)
            if runs:
                keep(runs, uses - filled, room)
            n -= filled * each
    return [pattern for found in open_.values() for pattern in found]


def ranges(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces go: length, first rank, first sequence, pieces in a row, offset. Its size depends on ``capacity`` only."""
    fixed, left = reduced(counts, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, uses in [*fixed, *best_fit(left, capacity)]:
        for length, offset, each in runs:
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * uses
        sequence += uses
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (a table of pieces with doc_id, piece, start, length) with ``sequence_id`` and ``offset``. It is read three times."""
    spark = found.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    counts = stored(marked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    # a row per length and bucket: at most capacity x buckets rows, at most ``buckets`` of them in one window
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = ranges(totals, capacity)
    if plan.empty:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    keys = plan["length"].to_numpy(np.int64) << 44 | plan["rank"].to_numpy(np.int64)
    first, rank, each, offset = (plan[c].to_numpy(np.int64) for c in ("sequence", "rank", "each", "offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.searchsorted(keys, frame["length"].to_numpy(np.int64) << 44 | frame["_rank"].to_numpy(np.int64), side="right") - 1
            behind = frame["_rank"].to_numpy(np.int64) - rank[at]
            frame = frame.drop(columns="_rank")
            frame["sequence_id"] = first[at] + behind // each[at]
            frame["offset"] = offset[at] + behind % each[at] * frame["length"].to_numpy(np.int64)
            yield frame

    in_order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = marked.withColumn("_n", F.row_number().over(in_order)).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*found.columns, (F.col("_before") + F.col("_n") - 1).alias("_rank"))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields]
    return ranked.mapInPandas(place, ", ".join([*names, "sequence_id bigint", "offset bigint"]))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: one row per piece."""
    return packed(stored(token_pieces(docs, vocabulary, capacity)), capacity)
