"""Collocations of two to four words, mined from one count of the longest windows.

Texts are lower-cased (A-Z only), split into pieces at ``[.,;:!?`` and line ends ``]`` and into words at blanks and tabs. Every
word begins one window: the word and its three followers inside the piece as four lead columns, padded with null behind the
piece's end. Only these windows are counted, inside the tasks first; Spark's ROLLUP over (group, word 1 .. word 4) then sums the
shorter prefixes, which are all shorter phrases, and the words of a group. Nothing is exploded per phrase length.

A phrase of ``min_count`` occurrences holds only pairs and triples of that many. So hashes of pairs are counted first, then those of
triples of frequent pairs, and a window is padded from the first pair or triple on whose hash is too rare. These bitmaps take 16 bits
a frequent hash and ``MAX_BITS`` at most; beyond that they only pad less. Counts are exact at any size of them: a padded word
cannot belong to a candidate.

Result of ``mined``: a row per phrase among the first ``limit`` of its group with ``rank``, ``phrase``, ``a`` (occurrences), ``l``
and ``r`` (those of both parts at its lowest-scoring cut), ``n`` (words of the group) and ``score``. Null texts are empty, a null
group is ``und``. Repeated rows and copies count as often as they stand. Ties of the score go to the smallest ``k``, ties of the
rank to ``a`` and then the phrase in byte order, so that ranks are unique. Texts without words and empty tables give no rows.
Other columns are never read. One text is worked on whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tanteo.llm.store import stored
from tanteo.llm.text import chunks, mixed, words

LONGEST, MIN_COUNT, LIMIT = 4, 30, 2000
SCALE, COVERED = 2_000_000, 80
#: Bytes of text whose windows are counted together inside a task.
TOGETHER = 4 << 20
#: The most bits of the bitmap of frequent pairs (128 MB), and its bits for each of them.
MAX_BITS, BITS_EACH = 1 << 30, 16
#: First-round groups of the ranking, so that no task ranks a whole language.
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words of all texts, the number of the piece of each (rising, never shared by two texts), and the text of each."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    if bounds[-1] == bounds[0]:
        return pa.array([], pa.large_string()).dictionary_encode(), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    data = _LOWER[data]
    bounds = bounds - bounds[0]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    text = np.searchsorted(bounds, first, side="right") - 1
    piece = np.cumsum(kind == 2)[first] + text
    return found.dictionary_encode(), piece, text


def _windows(texts: pa.Array, group: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, the windows as places in them (-1: padded), the group number of each window, and a hash of each of
    the window's first pair (0 where there is none)."""
    found, piece, text = split_words(texts)
    ids = np.full(len(found) + LONGEST, -1, np.int32)
    ids[: len(found)] = found.indices.to_numpy(zero_copy_only=False)
    lead = np.lib.stride_tricks.sliding_window_view(ids, LONGEST)[: len(found)].copy() if len(found) else np.empty((0, LONGEST), np.int32)
    last = np.full(len(found) + LONGEST, -1, np.int64)
    last[: len(found)] = piece
    for k in range(1, LONGEST):
        lead[last[k : k + len(found)] != piece, k] = -1
    # letters that the word hash lower-cases as well only make more pairs share a hash
    hashed = words(found.dictionary)[0] if len(found) else np.empty(0, np.uint64)
    which = group.dictionary_encode()
    names = np.array([hash_of(g) for g in which.dictionary.to_pylist()], np.uint64)
    at = which.indices.to_numpy(zero_copy_only=False)[text]
    pair = np.zeros(len(found), np.uint64)
    two = np.flatnonzero(lead[:, 1] >= 0) if len(found) else np.empty(0, np.int64)
    if len(two):
        pair[two] = mixed(mixed(hashed[lead[two, 0]] + names[at[two]]) * np.uint64(0x9E3779B97F4A7C15) + hashed[lead[two, 1]]) | np.uint64(1)
    return found.dictionary, lead, at, pair


def hash_of(name: str) -> int:
    return int(words(pa.array([f"g{name.encode().hex()}"]))[0][0])


def _short(hashed: np.ndarray) -> np.ndarray:
    """40 bits of a hash: what is counted and looked up."""
    return hashed >> np.uint64(24)


def _found(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the hashes; those that are 0 stand for nothing and are not found."""
    place = _short(hashed) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (hashed > 0)


def _triples(pair: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A hash of the window's first triple, 0 where one of its pairs is not frequent."""
    out = np.zeros(len(pair), np.uint64)
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    out[at] = mixed(pair[at] * np.uint64(0x9E3779B97F4A7C15) + pair[at + 1]) | np.uint64(1)
    return out


def _frequent(rows: DataFrame, min_count: int, pairs: Broadcast | None = None) -> np.ndarray:
    """A bitmap of the hashes of all pairs (with ``pairs``, their bitmap: of all triples) with ``min_count`` occurrences, and of those
    that share a bit with one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=TOGETHER):
                hashed = _windows(part.column("text"), part.column("lang"))[3]
                if pairs is not None:
                    hashed = _triples(hashed, _found(pairs.value, hashed))
                found, n = np.unique(_short(hashed[hashed > 0]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    often = stored(rows.mapInArrow(counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("hash"))
    bits, wanted = 1 << 15, BITS_EACH * often.count()
    while bits < min(wanted, MAX_BITS):
        bits *= 2
    # 32,768 bits a row: the driver gets the bitmap, never the hashes
    place = F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("place")
    parts = often.select(place).groupBy(F.shiftright("place", 15).alias("row")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bitmap"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for row, bitmap in parts.toLocalIterator():
        out[row] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def counts(docs: DataFrame, group: str = "lang", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, w1 .. w4, n): occurrences of every phrase of up to four words with ``min_count`` of them, and of each group's words
    (all four null)."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    pairs = spark.sparkContext.broadcast(_frequent(rows, min_count))
    triples = spark.sparkContext.broadcast(_frequent(rows, min_count, pairs))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=TOGETHER):
                found, lead, at, pair = _windows(part.column("text"), part.column("lang"))
                if not len(lead):
                    continue
                two = _found(pairs.value, pair)
                three = np.append(_found(triples.value, _triples(pair, two)), False)
                for k, on in enumerate((two, three[:-1], three[:-1] & three[1:]), 1):
                    lead[~on, k] = -1
                same = pa.table({"g": at, **{w: lead[:, k] for k, w in enumerate(_WORDS)}})
                same = same.group_by(["g", *_WORDS], use_threads=False).aggregate([([], "count_all")])
                names = part.column("lang").dictionary_encode().dictionary
                spelled = found.cast(pa.string())
                one = lambda ids: spelled.take(pc.if_else(pc.less(ids, 0), None, ids))
                for slot in same.to_batches(max_chunksize=1 << 14):
                    columns = [names.take(slot.column("g")), *[one(slot.column(w)) for w in _WORDS], slot.column("count_all")]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", *_WORDS, "n"])

    windows = rows.mapInArrow(counted, f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, n bigint")
    # bits of grouping_id: columns that ROLLUP summed over; a null that it did not put there is padding, and its rows are dropped
    # before they are summed
    summed = windows.rollup("lang", *_WORDS).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    level = [(F.col("level") == (1 << (LONGEST - length)) - 1) & (F.col(_WORDS[length - 1]).isNotNull() if length else F.lit(True)) for length in range(LONGEST + 1)]
    kept = reduce(Column.__or__, level)
    often = (F.col("n") >= min_count) | F.col("w1").isNull()
    return stored(summed.where(kept).where(often).select("lang", *_WORDS, "n"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def mined(docs: DataFrame, group: str = "lang", text: str = "text", min_count: int = MIN_COUNT, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` phrases of each group (module docstring); the group's column is called ``lang`` in the result."""
    known = counts(docs, group, text, min_count)
    spelled = F.array_compact(F.array(*_WORDS))
    totals = known.where("w1 IS NULL").select("lang", F.col("n").alias("words"))
    known = known.where("w1 IS NOT NULL").select("lang", _joined(spelled).alias("phrase"), spelled.alias("parts"), F.col("n").alias("a"))
    candidates = known.where(F.size("parts") > 1)
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
    cut = cut.withColumns({"left": _joined(F.slice("parts", 1, F.col("k"))), "right": _joined(F.slice("parts", F.col("k") + 1, LONGEST))})
    count = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cut = cut.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    one = lambda k, side: F.max(F.when(F.col("k") == k, F.col(side))).alias(f"{side}{k}")
    scored = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *[one(k, side) for k in range(1, LONGEST) for side in "lr"])
    # products pass 64 bits: a decimal quotient, rounded down; the score is at most half of SCALE, so that it and k fit into one number
    whole = lambda k: F.expr(f"(cast({SCALE} AS decimal(10,0)) * cast(a AS decimal(20,0))) div (cast(l{k} AS decimal(20,0)) + cast(r{k} AS decimal(20,0)))")
    best = F.least(*[whole(k) * LONGEST + k for k in range(1, LONGEST)])
    scored = scored.withColumn("best", best)
    side = lambda s: F.coalesce(*[F.when(F.col("best") % LONGEST == k, F.col(f"{s}{k}")) for k in range(1, LONGEST)]).alias(s)
    scored = scored.select("lang", "phrase", "a", side("l"), side("r"), F.floor(F.col("best") / LONGEST).cast("long").alias("score"))
    inside = [
        F.when(F.size("parts") >= at + n, _joined(F.slice("parts", at + 1, n)))
        for n in range(2, LONGEST) for at in range(LONGEST - n + 1)
    ]
    longer = candidates.where(F.size("parts") > 2).select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*inside))).alias("inner"))
    longer = longer.where("inner != phrase").groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("around"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVERED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    first = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(salted)).where(F.col("place") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
