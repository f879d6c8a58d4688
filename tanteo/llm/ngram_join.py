"""N-gram Jaccard join by MinHash banding, with every candidate pair verified on its full n-gram sets.

Words are lower-case runs without white space; a text of fewer than ``N`` words has one n-gram, itself, and a text without words
has none and links to nothing. Equal texts are one node, so copies are never paired with each other. Band and row counts come
from the wanted recall. Texts that share a band are linked to the smallest text of the band, not to each other; connected texts
form a candidate group, and all pairs inside a group are verified, in blocks of at most ``BLOCK`` texts, so that a group of any
size is many small tasks. A block returns a row per text (its links) and a spanning set of links, never all pairs.

Result: a row per document with ``class_id`` (the smallest id linked to it directly or through others), ``n_links`` (how many
other texts have a similarity of ``threshold`` or more) and ``n_copies`` (rows with this very text). Null texts count as empty; empty texts
are copies of each other and so one class. Repeated rows stay; null ids are allowed and never become a class id unless a class
has no other. Extra columns stay; the three result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanteo.llm.components import components
from tanteo.llm.store import stored
from tanteo.llm.text import chunks, grams, mixed, words

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
MAX_HASHES = 192
BLOCK = 256


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows a band (fewest false candidates) with which a pair at ``threshold`` shares a band with chance ``recall``."""
    found = (1, 1)
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows > max_hashes:
            break
        found = (bands, rows)
    return found


def _banded(docs: DataFrame, n: int, bands: int, rows: int, text: str) -> DataFrame:
    """(key, band, bucket) of every text with words; ``key`` is a digest of the text."""
    random = np.random.default_rng(20)
    factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found, begins = grams(*words(part.column("text")), n)
                filled = np.flatnonzero(np.diff(begins))
                if not len(filled):
                    continue
                at = begins[filled]
                # multiply-shift: the order of the high bits of factor x gram is a random order of the grams
                least = np.empty((len(filled), bands * rows), np.uint32)
                for i, factor in enumerate(factors):
                    least[:, i] = np.minimum.reduceat((found * factor >> np.uint64(32)).astype(np.uint32), at)
                value = np.zeros((len(filled), bands), np.uint64)
                for row in range(rows):
                    value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + least[:, row::rows] + np.uint64(row + 1))
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key").take(pa.array(np.repeat(filled, bands))),
                    "band": pa.array(np.tile(np.arange(bands, dtype=np.int32), len(filled))),
                    "bucket": pa.array(value.ravel().view(np.int64)),
                })

    frame = docs.select(F.md5(F.coalesce(text, F.lit(""))).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return frame.mapInArrow(run, "key string, band int, bucket bigint")


def _sets(texts: pd.Series, n: int) -> list[np.ndarray]:
    found, begins = grams(*words(pa.array(texts, pa.string())), n)
    return [np.unique(found[a:b]) for a, b in zip(begins, begins[1:], strict=False)]


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more (exactly), as a square of booleans."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(m), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    member, gram = member[shared], np.unique(gram[shared], return_inverse=True)[1]
    common = np.zeros((m, m), np.float32)
    order = np.argsort(gram, kind="stable")
    member, gram = member[order], gram[order]
    step = 2048
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, step):
        a, b = np.searchsorted(gram, (low, low + step))
        part = np.zeros((m, step), np.float32)
        part[member[a:b], gram[a:b] - low] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    # whole numbers, so that a similarity of exactly the threshold is a link
    scale = round(threshold * 10_000)
    yes = both * 10_000 >= union * scale
    np.fill_diagonal(yes, False)
    return yes


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text",
          block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, n_links) of every text with links, and a set of verified links (a, b) that connects what all links connect."""
    bands, rows = bands_and_rows(threshold, recall)
    banded = stored(_banded(docs, n, bands, rows, text).distinct())
    heads = banded.groupBy("band", "bucket").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    near = banded.join(heads, ["band", "bucket"]).where("key != head").select("key", "head").distinct()
    groups = stored(components(near, "key", "head"))
    # blocks of a group: members spread over its blocks by their digest
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    parts = F.greatest(F.lit(1), F.ceil(2 * F.col("_size") / block)).cast("int")
    placed = groups.join(sizes, "root").withColumns({"_parts": parts}).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("node", F.md5("text"))
    members = placed.join(texts, "node").dropDuplicates(["node"])
    # a member meets every block of its group, each pair of blocks once
    pairs = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        "root", F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j"), "_part", "node", "text"
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        nodes, part = frame["node"].to_numpy(object), frame["_part"].to_numpy()
        found = linked(_sets(frame["text"], n), threshold)
        if i != j:
            found &= part[:, None] != part[None, :]
        counts = found.sum(axis=1)
        root, seen = np.full(len(nodes), -1), np.zeros(len(nodes), bool)
        for start in np.flatnonzero(counts):
            if not seen[start]:
                todo, seen[start] = [start], True
                while todo:
                    at = todo.pop()
                    root[at] = start
                    new = np.flatnonzero(found[at] & ~seen)
                    seen[new] = True
                    todo.extend(new)
        yes = np.flatnonzero(counts)
        return pd.DataFrame({"node": nodes[yes], "head": nodes[root[yes]], "n_links": counts[yes].astype(np.int64)})

    checked = stored(pairs.groupBy("root", "i", "j").applyInPandas(verify, "node string, head string, n_links bigint"))
    degrees = checked.groupBy(F.col("node").alias("key")).agg(F.sum("n_links").alias("n_links"))
    return degrees, checked.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD,
           recall: float = RECALL) -> DataFrame:
    """``docs`` with ``class_id``, ``n_links`` and ``n_copies`` (module docstring)."""
    names = docs.columns
    frame = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, whole = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    degrees, spanning = links(frame, n, threshold, recall, whole)
    classes = components(spanning)
    rows = frame.withColumn("_key", F.md5(F.coalesce(whole, F.lit(""))))
    copies = rows.groupBy("_key").agg(F.min(own).alias("_least"), F.count(F.lit(1)).alias("n_copies"))
    known = copies.join(classes.select(F.col("node").alias("_key"), "root"), "_key", "left").join(degrees.withColumnRenamed("key", "_key"), "_key", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "_key")))
    least = known.groupBy("root").agg(F.min("_least").alias("class_id"))
    verdict = known.join(least, "root").select("_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    kept = [(i, c) for i, c in enumerate(names) if c not in ("class_id", "n_links", "n_copies")]
    return rows.join(verdict, "_key").select(*[F.col(f"c{i}").alias(c) for i, c in kept], "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id (of equal ids: any with the smallest text digest), columns as in ``docs``.

    Rows of a class with a null id only keep one of them.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, whole = (names[docs.columns.index(c)] for c in (doc_id, text))
    marked = docs.toDF(*names).withColumn("_digest", F.md5(F.coalesce(whole, F.lit(""))))
    found = stored(joined(marked.select(F.col(own).alias("doc_id"), F.col("_digest").alias("digest"), F.col(whole).alias("text"))).drop("text"))
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("_first"))
    chosen = first.select(F.col("_first.doc_id").alias("_id"), F.col("_first.digest").alias("_chosen")).distinct()
    kept = marked.join(chosen, F.col(own).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_chosen")), "left_semi")
    repeated = Window.partitionBy(own, "_digest").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(repeated)).where("_n = 1").select(*names).toDF(*docs.columns)
