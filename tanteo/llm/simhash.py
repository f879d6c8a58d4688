"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z only) and split into words at ASCII white space; its shingles are all runs of three words joined by one
space, repeats included. A text of one or two words has one shingle, the words themselves. Bit b of the 64-bit fingerprint is set
if it is set in more than half of the shingles' XXH64 values (seed 42). Null, empty and blank texts have fingerprint zero and are
linked like any other.

Two fingerprints that differ in at most ``BITS`` bits agree in ``BLOCKS`` - ``BITS`` of ``BLOCKS`` blocks of bits at least. Every
different fingerprint is put once into the bucket of each choice of that many blocks (20 buckets keyed by 31 to 33 bits), so that each
close pair meets, and unrelated fingerprints rarely do. A bucket of more than ``CELL`` fingerprints is dealt into parts, each pair
of parts into one cell, so that no task holds more than two parts. Inside a cell the Hamming distance of every pair is taken; the
cell returns only a spanning set of its links, never all pairs. Connected fingerprints form a component.

Result of ``linked``: all rows of ``docs`` with ``fingerprint`` (16 lower-case hex digits) and ``component_id`` (the smallest
document id that close fingerprints lead to, its own included). Equal texts have equal fingerprints, so copies are one node.
Repeated rows stay. Null ids never become a component id unless the component has no other. Extra columns stay, whatever their
names; columns called like the two results are replaced. Empty tables give an empty table. Long texts are hashed whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tanteo.llm.components import components
from tanteo.llm.store import stored

WORDS, SEED = 3, 42
BITS, BLOCKS = 3, 6
CELL = 1024
#: Keys that hold at least one row in so many are joined by a broadcast: there can be no more than that many of them.
HOT = 1000
#: Shingles whose bits are counted at once.
_STEP = 1 << 18


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    hashed = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    totals = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = hashed[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > n, bitorder="little").tobytes(), "little")


def fingerprinted(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with its columns named by position (c0, c1 ..) and ``fp``, the fingerprint as a signed 64-bit number."""
    at = docs.columns.index(text)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = [f for i, f in enumerate(named.schema.fields) if keep_text or i != at]
    fields = [StructField(f.name, f.dataType, True) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "").cast(pa.large_binary()).to_pylist()
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*[f.name for f in fields], "fp"])

    return named.mapInArrow(run, StructType([*fields, StructField("fp", LongType())]))


def block_choices(bits: int = BITS, blocks: int = BLOCKS) -> list[list[tuple[int, int]]]:
    """For every choice of ``blocks`` - ``bits`` blocks the (lowest bit, width) of each: any pair of fingerprints that differs in
    ``bits`` bits agrees in all blocks of one choice."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in itertools.pairwise(bounds)]
    return [list(c) for c in itertools.combinations(spans, blocks - bits)]


def _buckets(prints: DataFrame) -> DataFrame:
    """(bucket, fp): each fingerprint in the bucket of every choice of blocks."""
    keys = []
    for number, choice in enumerate(block_choices()):
        key = F.lit(number).cast("long")
        for low, width in choice:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def spanning(prints: np.ndarray, part: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, head) that connect what all close pairs of a cell connect; with two parts, only pairs across them count."""
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    if part[0] != part[-1] or (part != part[0]).any():
        close &= part[:, None] != part[None, :]
    else:
        np.fill_diagonal(close, False)
    head, seen = np.full(len(prints), -1), np.zeros(len(prints), bool)
    for start in np.flatnonzero(close.any(axis=1)):
        if not seen[start]:
            todo, seen[start] = [start], True
            while todo:
                at = todo.pop()
                head[at] = start
                new = np.flatnonzero(close[at] & ~seen)
                seen[new] = True
                todo.extend(new)
    yes = np.flatnonzero((head >= 0) & (head != np.arange(len(prints))))
    return prints[yes], prints[head[yes]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of every cell; the rows of a cell follow each other."""
    rest = np.empty((0, 5), np.int64)

    def cells(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, heads = [], []
        prints = rows[:, 4].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        starts = np.concatenate(([0], ends[:-1]))
        size = ends - starts
        # the usual cell has two fingerprints: all of these at once
        a, b = prints[starts[size == 2]], prints[starts[size == 2] + 1]
        across = (rows[starts[size == 2], 1] == rows[starts[size == 2], 2]) | (rows[starts[size == 2], 3] != rows[starts[size == 2] + 1, 3])
        yes = (np.bitwise_count(a ^ b) <= BITS) & across
        nodes.append(a[yes])
        heads.append(b[yes])
        for start, end in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            one, two = spanning(prints[start:end], rows[start:end, 3]) if rows[start, 1] == rows[start, 2] or len(set(rows[start:end, 3])) > 1 else ((), ())
            nodes.append(np.asarray(one, np.uint64))
            heads.append(np.asarray(two, np.uint64))
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(nodes).view(np.int64)), "b": pa.array(np.concatenate(heads).view(np.int64))})

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rows = np.concatenate((rest, rows))
        ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        if len(ends):
            yield from cells(rows[: ends[-1]], ends)
            rest = rows[ends[-1] :]
        else:
            rest = rows
    if len(rest):
        yield from cells(rest, np.array([len(rest)]))


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within ``BITS`` bits of each other; ``prints`` has each of them once."""
    buckets = stored(_buckets(prints))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / cell).cast("int")
    dealt = buckets.join(sizes, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    cells = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(_verified, "a bigint, b bigint")


def _matched(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; ``weight`` says how many rows have the key. Keys with a large share of the rows go by
    a broadcast of at most ``HOT`` table rows, so that the shuffled join has no hot key."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * HOT >= F.lit(total)))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(table.where(F.col(weight) * HOT < F.lit(total)), key))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, cell: int = CELL) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``component_id`` (module docstring); without the text column if not ``keep_text``."""
    names = docs.columns
    rows = stored(fingerprinted(docs, text, keep_text))
    own = f"c{names.index(doc_id)}"
    prints = stored(rows.groupBy("fp").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints.select("fp"), cell))
    known = stored(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    verdict = _matched(known.drop("least"), stored(ids), "root", "members").select("fp", "n", "component_id")
    found = _matched(rows, stored(verdict), "fp", "n")
    kept = [(i, c) for i, c in enumerate(names) if c not in ("fingerprint", "component_id") and (keep_text or c != text)]
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in kept], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
