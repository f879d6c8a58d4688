"""Packed token ids: best-fit decreasing with a segment tree over free capacities, in binary rows.

Each task reads its documents once and packs them buffer by buffer, so it holds ``buffer_tokens`` tokens at most (or one
document), and nothing is shuffled. A sequence becomes one row: its ids as a little-endian unsigned 32-bit row of the id matrix,
filled up with ``pad_id``, cumulative segment lengths from 0 to the tokens used, and positions that begin again at 0 with each
segment. Documents longer than a sequence are cut into pieces without losing a token.

A null or empty text is one segment, the end id alone. Repeated rows are packed one by one. Only the id and text columns are
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.llm.best_fit_packing import CAPACITY, END_ID
from tanteo.llm.text import chunks
from tanteo.llm.tokens import default_vocabulary, encoder, pieces

#: Tokens packed together; what does not fill a sequence at the end of a buffer is its only loss.
BUFFER_TOKENS = 1 << 21


class FreeSpace:
    """A segment tree over free capacities: how many sequences have each, and the smallest that holds a piece."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.holders: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, sequence: int) -> None:
        self.holders[free].append(sequence)
        self._count(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(free, sequence) with the least free space of ``length`` or more, taken out; None if there is none."""
        node = length + self.size
        while not self.tree[node]:
            while node & 1:
                if node == 1:
                    return None
                node >>= 1
            if node <= 1:
                return None
            node += 1
            if not node & (node - 1):
                return None
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        free = node - self.size
        self._count(free, -1)
        return free, self.holders[free].pop()

    def _count(self, free: int, change: int) -> None:
        node = free + self.size
        while node:
            self.tree[node] += change
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers, in the order in which the pieces lie there."""
    space, out = FreeSpace(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = space.take(lengths[piece])
        if found is None:
            free, sequence = capacity, len(out)
            out.append([])
        else:
            free, sequence = found
        out[sequence].append(piece)
        if free > lengths[piece]:
            space.add(free - lengths[piece], sequence)
    return out


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, pad_id: int = END_ID,
              buffer_tokens: int = BUFFER_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: shard, sequence, ids (binary), cu_seqlens, positions (binary), doc_ids, starts, n_tokens."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard int, sequence bigint, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, starts array<bigint>, n_tokens int"

    def rows(buffer: list[tuple], shard: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
        made = [[] for _ in range(8)]
        for n, members in enumerate(best_fit_decreasing([len(x[2]) for x in buffer], capacity)):
            row, places = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
            ends = np.cumsum([0, *(len(buffer[m][2]) for m in members)])
            for m, at in zip(members, ends, strict=False):
                row[at : at + len(buffer[m][2])] = buffer[m][2]
                places[at : at + len(buffer[m][2])] = np.arange(len(buffer[m][2]))
            values = (shard, first + n, row.tobytes(), ends, places.tobytes(), [buffer[m][0] for m in members], [buffer[m][1] for m in members], ends[-1])
            for column, value in zip(made, values, strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.int32())
        names = ("shard", "sequence", "ids", "cu_seqlens", "positions", "doc_ids", "starts", "n_tokens")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path).ids, TaskContext.get().partitionId()
        buffer, held, first, id_type = [], 0, 0, pa.null()
        for batch in batches:
            for part in chunks(batch, "text"):
                id_type = part.column("doc_id").type
                for key, content in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    whole = np.append(encode(content), np.uint32(END_ID))
                    if held and held + len(whole) > buffer_tokens:
                        yield (out := rows(buffer, shard, first, id_type))
                        buffer, held, first = [], 0, first + out.num_rows
                    buffer += [(key, start, whole[start : start + n]) for start, n in pieces(len(whole), capacity)]
                    held += len(whole)
        if buffer:
            yield rows(buffer, shard, first, id_type)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the sequences to ``path`` (a folder that all executors reach) as Parquet rows, one id row each."""
    sequences(docs, **options).write.mode("error").parquet(path)
