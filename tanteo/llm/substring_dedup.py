"""Substring dedup by collinear chaining: shared k-mer seeds, chains with gap costs, and an alignment of each chain.

Seeds are hashes of ``K`` words, one for every run of ``WINDOW`` neighbouring hashes (the smallest), so two texts with an equal
passage of ``K + WINDOW - 1`` words share a seed; a seed and the one behind it are a seed, too. All texts with a seed meet its head,
the text with the smallest key, and not each other: rows grow with the occurrences, not with their pairs. A seed in a frequent
phrase has a head that need not share more than the phrase. So every run of ``MIN_WORDS`` words that may stand in two texts has a
head as well, at every place of every text: any head of such a run shares a whole passage, at whatever place it has the run, and
each word that stands in an equal passage of ``MIN_WORDS`` words with any other text is in a span, except in the run's head itself. A
run may stand in two texts if all seeds that are chosen by windows inside it do, since both texts choose the same ones there;
these seeds are looked up in a bitmap of bounded size, which can only let more runs through. Seeds that no other text has, by the same
bitmap, are not dealt out with their places.

The seeds that a text shares with one head are chained in word order on both sides; a chain earns a seed's new words and pays
``GAP`` for every word skipped on either side, and a Fenwick tree over the head's positions finds the best chain to extend. A chain is extended over equal words at both ends and aligned: it is a
repeated passage if it has ``MIN_WORDS`` words and the longest common subsequence of the two sides is ``MIN_SHARE`` of their mean
length. Chains of one text and head near each other share one slice of either text.

Result: a row per document with ``spans`` (start, end in words, the id of the document with the head's text), ``n_words``,
``n_repeat_words`` (words in spans), ``n_first_words`` (words, in steps of ``STEP``, that later texts repeat from this one), and
``copy_of`` (the smallest id with this very text, where that is another row's). Copies get the spans of their text.

Texts are keyed by a 64-bit hash. Null texts count as empty and have no words; repeated rows stay; a null id is no one's
``copy_of``. Extra columns stay; result columns replace columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanteo.llm.bitmap import bitmap_of, has
from tanteo.llm.store import stored
from tanteo.llm.text import chunks, grams, mixed, words

K, WINDOW = 8, 16
#: Cost of a skipped word, on either side.
GAP = 0.1
#: Words by which the slices to align go beyond a chain.
REACH = 48
MIN_WORDS, MIN_SHARE = 40, 0.8
STEP = 8
RESULT = ("spans", "n_words", "n_repeat_words", "n_first_words", "copy_of")
#: As ``words`` splits: ASCII white space.
_BLANK = "[\\x20\\x09-\\x0D]+"


def _least(values: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the smallest of each value and the ``window`` - 1 behind it inside one text stands, and whether there are so many."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    place, least, size = np.arange(len(values)), values.copy(), 1
    if not len(values):
        return place, np.zeros(0, bool)
    # the best of the next 2, 4, 8 ... values; the window is a power of two
    while size < window:
        other, at = np.full_like(least, top), place.copy()
        other[:-size], at[:-size] = least[size:], place[size:]
        beyond = np.ones(len(values), bool)
        beyond[:-size] = owner[size:] != owner[:-size]
        other[beyond] = top
        better = other < least
        least, place, size = np.where(better, other, least), np.where(better, at, place), 2 * size
    return place, np.arange(len(values)) + window <= begins[1:][owner]


def smallest(values: np.ndarray, begins: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value of every run of ``window`` neighbours inside one text (of a shorter text, of all it has)."""
    place, whole = _least(values, begins, window)
    whole[begins[:-1][np.diff(begins) > 0]] = True
    return np.unique(place[whole])


def repeatable(
    hashed: np.ndarray, offsets: np.ndarray, bitmap: np.ndarray, k: int = MIN_WORDS, grams_of: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """For each run of ``k`` words (as ``grams`` has them), whether all seeds chosen by windows inside it are in the bitmap."""
    found, begins = grams_of or grams(hashed, offsets, K)
    runs = np.diff(grams_begin(offsets, k))
    place, _ = _least(found, begins, WINDOW)
    # seeds not in the bitmap, summed up to each place
    missing = np.concatenate(([0], np.cumsum(~has(bitmap, found[place])))) if len(found) else np.zeros(1, np.int64)
    inside = k - K + 1 - WINDOW + 1
    at = np.repeat(begins[:-1] - np.concatenate(([0], np.cumsum(runs)))[:-1], runs) + np.arange(runs.sum())
    long = np.repeat(np.diff(offsets) >= k, runs)
    out = np.zeros(len(at), bool)
    out[long] = missing[at[long] + inside] == missing[at[long]]
    return out


def grams_begin(offsets: np.ndarray, n: int) -> np.ndarray:
    """Where each text's runs of ``n`` words begin."""
    lengths = np.diff(offsets)
    return np.concatenate(([0], np.cumsum(np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1)))))


def _seeds(docs: DataFrame, text: str, sent: Broadcast | None = None) -> DataFrame:
    """(seed, key, at, equal): one row for each seed of a text, with all its places; a line that fills a text is one row, not thousands.

    Pairs of neighbouring seeds are seeds at the first's place. With the bitmap ``sent`` of the seeds that may stand in two texts, only
    those (and pairs of them) come, and every run of ``MIN_WORDS`` words that may stand in two texts is a seed as well (``equal``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashed, offsets = words(part.column("text"))
                found, begins = grams(hashed, offsets, K)
                at = smallest(found, begins)
                row = np.searchsorted(begins, at, side="right") - 1
                at, row = at[(whole := np.diff(offsets)[row] >= K)], row[whole]
                seed = found[at]
                known = np.ones(len(at), bool) if sent is None else has(sent.value, seed)
                both = np.flatnonzero((np.diff(row) == 0) & known[:-1] & known[1:]) if len(at) else at
                pair = mixed(seed[both] * np.uint64(0x9E3779B97F4A7C15) + seed[both + 1])
                found_at = [(seed[known], row[known], (at - begins[row])[known], False), (pair, row[both], (at - begins[row])[both], False)]
                if sent is not None:
                    found_at.append((*runs(hashed, offsets, found, begins, sent.value), True))
                for equal in (False, True):
                    group = [x[:3] for x in found_at if x[3] == equal]
                    if not group:
                        continue
                    seed, row, at = (np.concatenate(x) for x in zip(*group, strict=True))
                    order = np.lexsort((at, seed, row))
                    at, row, seed = at[order], row[order], seed[order].view(np.int64)
                    first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(seed) != 0))) if len(at) else at
                    yield pa.RecordBatch.from_pydict({
                        "seed": pa.array(seed[first]), "key": part.column("key").take(pa.array(row[first])),
                        "at": pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at.astype(np.int32))),
                        "equal": pa.array(np.full(len(first), equal)),
                    })

    schema = "seed bigint not null, key bigint not null, at array<int>, equal boolean not null"
    return docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def runs(hashed: np.ndarray, offsets: np.ndarray, found: np.ndarray, begins: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of each run of ``MIN_WORDS`` words that may be repeated; ``found`` and ``begins`` are its ``grams`` of ``K``."""
    starts = grams_begin(offsets, MIN_WORDS)
    at = np.flatnonzero(repeatable(hashed, offsets, bitmap, grams_of=(found, begins)))
    row = np.searchsorted(starts, at, side="right") - 1
    at = at - starts[row]
    seed = np.zeros(len(at), np.uint64)
    # grams side by side, the last one up to the run's end
    for k in (*range(0, MIN_WORDS - K, K), MIN_WORDS - K):
        seed = mixed(seed * np.uint64(0x9E3779B97F4A7C15) + found[begins[row] + at + k])
    return seed, row, at


class Fenwick:
    """Largest value, and whose it is, over the first positions."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def raise_to(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        """Over the positions below ``at``."""
        out = (-np.inf, -1)
        while at:
            out = max(out, self.best[at])
            at &= at - 1
        return out


def chains(here: np.ndarray, there: np.ndarray, k: int = K, gap: float = GAP) -> list[tuple[int, int, int, int, float]]:
    """Best chains of seeds at (here, there): (start, end, start there, end there, score), every seed in one chain at most."""
    order = np.lexsort((there, here))
    here, there = here[order].tolist(), there[order].tolist()
    ends = sorted({v + k for v in there})
    # the places in the tree of each seed's end, and of the last one not behind its start, on the other side
    own = np.searchsorted(ends, np.array(there) + k, side="left").tolist()
    below = np.searchsorted(ends, there, side="right").tolist()
    tree, score, back = Fenwick(len(ends)), [float(k)] * len(here), [-1] * len(here)
    diagonal: dict[int, int] = {}
    passed = 0
    for n, (at, to) in enumerate(zip(here, there, strict=True)):
        # seeds that end before this one on this side; the tree orders them by their end on the other
        while here[passed] + k <= at:
            tree.raise_to(own[passed], (score[passed] + gap * (here[passed] + there[passed] + 2 * k), passed))
            passed += 1
        value, before = tree.before(below[n]) if passed else (-np.inf, -1)
        linked = value - gap * (at + to) + k
        # one that overlaps this seed earns its new words if it is shifted alike on both sides
        last = diagonal.get(at - to)
        if last is not None and at - here[last] < k and score[last] + at - here[last] >= linked:
            linked, before = score[last] + at - here[last], last
        if before >= 0 and linked > k:
            score[n], back[n] = linked, before
        diagonal[at - to] = n
    used, out = set(), []
    for end in sorted(range(len(here)), key=lambda n: -score[n]):
        if end in used:
            continue
        at = first = end
        while at >= 0 and at not in used:
            used.add(at)
            first, at = at, back[at]
        out.append((here[first], here[end] + k, there[first], there[end] + k, score[end]))
    return out


def stretches(head: np.ndarray, at: np.ndarray, there: np.ndarray, k: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(head, start, end, start there, end there) of equal runs of ``k`` words put together where they go on alike on both sides."""
    if not len(at):
        return []
    order = np.lexsort((at, at - there, head))
    head, at, there = head[order], at[order], there[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(head) != 0) | (np.diff(at) != 1) | (np.diff(there) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(*(x.tolist() for x in (head[first], at[first], at[last] + k, there[first], there[last] + k)), strict=True))


def _chained(table: pa.Table) -> pa.Table:
    """The chains of a text with each of its heads, those near each other on both sides in one row."""
    table = table.combine_chunks()
    lists = table.column("at").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy()
    head, there, equal = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("head", "there", "equal"))
    rows = stretches(head[equal], at[equal], there[equal])
    wholes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for h, a, b, c, _ in rows:
        wholes.setdefault((h, a - c), []).append((a, b))
    # a seed and its pair may have the same head and place
    seeds = np.unique(np.stack((head[~equal], at[~equal].astype(np.int64), there[~equal].astype(np.int64))), axis=1)
    begins = np.flatnonzero(np.append(True, np.diff(seeds[0]) != 0)) if seeds.size else np.zeros(0, int)
    for low, high in zip(begins.tolist(), [*begins[1:].tolist(), seeds.shape[1]], strict=False):
        h = int(seeds[0, low])
        for a, b, c, d, _ in chains(seeds[1, low:high], seeds[2, low:high]):
            # one inside an equal stretch goes on to the same places at most
            if b - a + 2 * (WINDOW + K) >= MIN_WORDS and not (b - a == d - c and _inside(wholes.get((h, a - c)), a, b)):
                rows.append((h, a, b, c, d))
    out: list[tuple[int, list[tuple[int, int, int, int]]]] = []
    last = None
    for h, a, b, c, d in sorted(set(rows)):
        near = last is not None and h == last[0] and a <= last[1] + 2 * REACH and c <= last[3] + 2 * REACH and d + 2 * REACH >= last[2]
        if near:
            out[-1][1].append((a, b, c, d))
            last = (h, max(b, last[1]), min(c, last[2]), max(d, last[3]))
        else:
            out.append((h, [(a, b, c, d)]))
            last = (h, b, c, d)
    if not out:
        return pa.table({"key": pa.array([], pa.int64()), "head": pa.array([], pa.int64()), "found": pa.array([], pa.list_(_CHAIN))})
    found = pa.array([[dict(zip("abcd", x, strict=True)) for x in group] for _, group in out], pa.list_(_CHAIN))
    key = table.column("key")[0].as_py()
    return pa.table({"key": pa.array([key] * len(out), pa.int64()), "head": pa.array([h for h, _ in out], pa.int64()), "found": found})


_CHAIN = pa.struct([(c, pa.int32()) for c in "abcd"])


def _inside(stretches: list[tuple[int, int]] | None, a: int, b: int) -> bool:
    """Whether one of the stretches (their starts and ends rise) holds a to b."""
    if not stretches:
        return False
    i = bisect_right(stretches, a, key=lambda s: s[0]) - 1
    return i >= 0 and b <= stretches[i][1]


def common_words(one: list[str], two: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, word in enumerate(one):
        masks[word] = masks.get(word, 0) | 1 << i
    row = full = (1 << len(one)) - 1
    for word in two:
        if match := masks.get(word):
            kept = row & match
            row = ((row + kept) | (row - kept)) & full
    return len(one) - row.bit_count()


def grown(one: list[str], two: list[str]) -> int:
    """By how many words a passage goes on, over single changed words if the four words behind them agree."""
    n = good = 0
    while n < min(len(one), len(two)):
        if one[n] == two[n]:
            good = n + 1
        elif len(behind := one[n + 1 : n + 5]) < 4 or behind != two[n + 1 : n + 5]:
            break
        n += 1
    return good


def aligned(mine: list[str], theirs: list[str], a: int, b: int, c: int, d: int) -> tuple[int, int, int, int] | None:
    """The chain mine[a:b], theirs[c:d] extended at both ends, if it is a repeated passage."""
    before, behind = grown(mine[:a][::-1], theirs[:c][::-1]), grown(mine[b:], theirs[d:])
    a, b, c, d = a - before, b + behind, c - before, d + behind
    if b - a < MIN_WORDS:
        return None
    one, two = mine[a:b], theirs[c:d]
    if one != two and 2 * common_words(one, two) < MIN_SHARE * (b - a + d - c):
        return None
    return a, b, c, d


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            mine, theirs = r.mine.split(" "), r.theirs.split(" ")
            for x in r.found:
                a, b, c, d = x["a"], x["b"], x["c"], x["d"]
                # places are counted from where the slices begin
                from_a, from_c = max(0, a - REACH), max(0, c - REACH)
                one, two = (mine[from_a - r.from_a : b + REACH - r.from_a], theirs[from_c - r.from_c : d + REACH - r.from_c])
                if found := aligned(one, two, a - from_a, b - from_a, c - from_c, d - from_c):
                    a, b, c, d = found
                    rows.append((r.key, r.head, from_a + a, from_a + b, from_c + c, from_c + d))
        yield pd.DataFrame(rows, columns=["key", "head", "a", "b", "c", "d"])


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, head, a, b, c, d): words a to b of the text ``key`` repeat words c to d of the text ``head``."""
    given = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    # only the low bits of a seed are looked up, and fewer bits take less room on the way
    low = F.col("seed").bitwiseAND(F.lit((1 << 40) - 1)).alias("seed")
    often = _seeds(given, "text").select(low, "key").repartition("seed").groupBy("seed").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(stored(often.where("a != b").select("seed")), "seed"))
    # the head is the text with the smallest key; copies of a text have the same rows side by side
    texts_of = Window.partitionBy("seed", "equal").orderBy("key")
    links = _seeds(given, "text", sent).select(
        "key", "at", "equal", F.lag("key").over(texts_of).alias("before"), F.first("key").over(texts_of).alias("head"),
        F.first(F.col("at")[0]).over(texts_of).alias("there"),
    ).where("key != head and key != before").select("key", "head", "there", "at", "equal")
    found = stored(links.groupBy("key").applyInArrow(_chained, "key bigint, head bigint, found array<struct<a:int,b:int,c:int,d:int>>"))
    found = found.select("*", *[
        F.greatest(F.lit(0), F.array_min(f"found.{c}") - REACH).alias(f"from_{c}") for c in "ac"
    ], *[(F.array_max(f"found.{c}") + REACH).alias(f"to_{c}") for c in "bd"])
    texts = given.select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"])
    texts = texts.select("key", F.array_remove(F.split(F.lower("text"), _BLANK), "").alias("_words"))

    def cut(start: str, end: str) -> Column:
        return F.array_join(F.slice("_words", F.col(start) + 1, F.col(end) - F.col(start)), " ")

    mine = found.join(texts, "key").withColumn("mine", cut("from_a", "to_b")).drop("_words")
    both = mine.join(texts.withColumnRenamed("key", "head"), "head").withColumn("theirs", cut("from_c", "to_d")).drop("_words")
    both = both.select("key", "head", "found", "from_a", "from_c", "mine", "theirs")
    return both.mapInPandas(_aligned, "key bigint, head bigint, a int, b int, c int, d int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT`` (module docstring)."""
    names = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    found = stored(passages(docs, text))
    rows = docs.select(*names, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_key"),
                       F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), _BLANK), "")).cast("long").alias("n_words"))
    first = stored(rows.groupBy("_key").agg(F.min(f"`{doc_id}`").alias("_first")))
    named = found.join(first.select(F.col("_key").alias("head"), F.col("_first").alias("doc_id")), "head")
    # a span inside another one with the same head says nothing new
    wider = Window.partitionBy("key", "head").orderBy("a", F.desc("b"), "c", "d").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("_reach", F.max("b").over(wider)).where("_reach is null or _reach < b")
    # a text's spans are at most its words; so are the steps of a head's words
    spans = named.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct(F.col("a").alias("start"), F.col("b").alias("end"), "doc_id"))).alias("spans"))
    steps = found.select(F.col("head").alias("_key"), F.explode(F.sequence(F.floor(F.col("c") / STEP), F.floor((F.col("d") - 1) / STEP))).alias("_step")).distinct()
    steps = steps.groupBy("_key").agg((F.count(F.lit(1)) * STEP).alias("_shared"))
    known = first.join(spans, "_key", "left").join(steps, "_key", "left")
    covered = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda t, s: F.struct(F.greatest(t["end"], s["end"]).alias("end"), (t["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(t["end"], s["start"]))).cast("long").alias("n")),
    )["n"]
    out = rows.join(known, "_key")
    return out.select(
        *names, "n_words", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType)).alias("spans"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.least(F.coalesce("_shared", F.lit(0)), F.col("n_words")).cast("long").alias("n_first_words"),
        F.when(F.col(f"`{doc_id}`") != F.col("_first"), F.col("_first")).alias("copy_of"),
    )
