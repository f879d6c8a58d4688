"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

``fit`` learns the lexicon from labelled rows: whole words and word beginnings that toxic texts have far more often than clean
ones, weighted by the log-ratio of their document counts; equal texts count once. Phrases of two words around an entry that clean
texts have are exceptions: an entry inside one counts nothing. The fit reads at most ``FIT_TEXTS`` texts of each label, those
with the smallest id hash; the lexicon, small by that bound, is sent to the tasks, and every text is scored whole.

Folding: lower case, letters that look like Latin ones, digits and signs that stand for letters, invisible characters removed.

A null text is an empty one; an empty text scores as one without matches. A label that is null, or an id without one, is not read.
With no toxic label nothing matches and every text scores low. Repeated rows are scored one by one; extra columns stay
(``score`` replaces a column of that name).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.llm.store import stored
from tanteo.llm.text import chunks

#: Texts of each label that the fit reads at most.
FIT_TEXTS = 3_000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
#: An entry needs so many toxic texts, this share of them, and a weight (log of the ratio of shares) of so much.
MIN_TEXTS, MIN_SHARE, MIN_WEIGHT = 4, 0.01, 2.5
#: An exception phrase needs so many clean texts for each toxic one.
EXCEPTION_RATIO = 2
#: Code points by which the length in the score grows by one step.
LENGTH_STEP = 500.0

# Letters of other scripts that look like Latin ones, signs that stand for letters, and invisible characters.
_LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ɡ": "g", "ⅼ": "l",
    "ı": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_FOLD = {ord(k): v for k, v in _LOOK_ALIKE.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_WORD = re.compile(r"\w+")
_NEXT = re.compile(r"\W+(\w+)")
_IN_WORD = re.compile(r"\w").match


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """``words`` match whole, ``beginnings`` at a word's start; ``exceptions`` are phrases of two words joined by a blank."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    #: Strength at which a text is as likely toxic as not.
    middle: float = 1.0


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for entry in {*lexicon.words, *lexicon.beginnings}:
            self.automaton.add_word(entry, entry)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, weight) of each word of the folded ``text`` with an entry, by its strongest entry."""
        if self.empty:
            return
        best: dict[int, tuple[float, int]] = {}
        for last, entry in self.automaton.iter(text):
            start = last - len(entry) + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            ends = last + 1 == len(text) or not (text[last + 1].isalnum() or text[last + 1] == "_")
            weight = max(self.lexicon.beginnings.get(entry, 0.0), self.lexicon.words.get(entry, 0.0) if ends else 0.0)
            if weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, last + 1)
        for start, (weight, _) in best.items():
            end = _WORD.match(text, start).end()
            yield start, end, weight

    def strength(self, text: str | None) -> float:
        folded = fold(text or "")
        total = sum(w for a, b, w in self.hits(folded) if not self.lexicon.exceptions & set(_phrases(folded, a, b)))
        return total / math.log2(2 + len(folded) / LENGTH_STEP)


def _phrases(text: str, start: int, end: int) -> list[str]:
    """The word at start:end with the word before it, and with the word behind it, however far off they are."""
    word, out = text[start:end], []
    last = start
    while last and not _IN_WORD(text[last - 1]):
        last -= 1
    first = last
    while first and _IN_WORD(text[first - 1]):
        first -= 1
    if first < last < start:
        out.append(f"{text[first:last]} {word}")
    if behind := _NEXT.match(text, end):
        out.append(f"{word} {behind[1]}")
    return out


def _entries(sample: DataFrame) -> DataFrame:
    """(entry, whole, toxic, clean): in how many texts of each label a word or word beginning stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                counts = (Counter(), Counter())
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    found = set(_WORD.findall(fold(text)))
                    counts[label].update((w, True) for w in found)
                    counts[label].update({(w[:n], False) for w in found for n in BEGINNINGS if len(w) >= n})
                keys = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_pydict({
                    "entry": pa.array([k[0] for k in keys], pa.string()), "whole": pa.array([k[1] for k in keys], pa.bool_()),
                    "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "clean": pa.array([counts[0][k] for k in keys], pa.int64()),
                })

    found = sample.mapInArrow(run, "entry string, whole boolean, toxic bigint, clean bigint")
    return found.groupBy("entry", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen(ids: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic", texts: int = FIT_TEXTS) -> DataFrame:
    """(id, label) of the rows that a fit on ``ids`` would read, found without their texts: at most ``texts`` of each label."""
    known = labels.where(F.col(toxic).isin(0, 1)).select(doc_id, toxic).join(ids.select(doc_id), doc_id, "left_semi")
    of = lambda label: known.where(F.col(toxic) == label).orderBy(F.xxhash64(doc_id), doc_id).limit(texts)
    return of(0).unionByName(of(1))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", texts: int = FIT_TEXTS) -> Lexicon:
    """The lexicon of ``labelled`` (id, text, label 0 or 1)."""
    rows = labelled.where(F.col(toxic).isin(0, 1)).select(
        F.coalesce(text, F.lit("")).alias("text"), F.col(toxic).cast("int").alias("toxic"), F.xxhash64(doc_id).alias("_order"),
    ).withColumn("_digest", F.md5("text"))
    # the rows are chosen by digests; only the chosen texts, at most two times ``texts``, leave their place
    keys = [rows.where(F.col("toxic") == label).select("_order", "_digest", "toxic").orderBy("_order", "_digest").limit(texts) for label in (0, 1)]
    chosen_rows = rows.join(F.broadcast(keys[0].unionByName(keys[1]).distinct()), ["_order", "_digest", "toxic"], "left_semi")
    sample = stored(chosen_rows.groupBy("text", "toxic").agg(F.count(F.lit(1)).alias("_n")).drop("_n").repartition("text"))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_toxic:
        return Lexicon({}, {})
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = _entries(sample).where(F.col("toxic") >= max(MIN_TEXTS, MIN_SHARE * n_toxic)).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    words, beginnings = {}, {}
    for r in strong.orderBy("entry", "whole").collect():  # bounded by the words of the sample
        (words if r.whole else beginnings)[r.entry] = r.weight
    lexicon = Lexicon(words, beginnings)
    return _calibrated(sample, _with_exceptions(sample, lexicon))


def _with_exceptions(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            phrases, labels = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text)
                found = {p for a, b, _ in matcher.hits(folded) for p in _phrases(folded, a, b)}
                phrases += found
                labels += [label] * len(found)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrases, pa.string()), "toxic": pa.array(labels, pa.int32())})

    counts = sample.mapInArrow(run, "phrase string, toxic int").groupBy("phrase").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")
    )
    found = counts.where((F.col("clean") >= 2) & (F.col("clean") > EXCEPTION_RATIO * F.col("toxic"))).collect()
    return Lexicon(lexicon.words, lexicon.beginnings, frozenset(r.phrase for r in found))


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """``middle`` halfway between the strengths that part the labels of the sample best."""
    strengths = sample.select("text", "toxic").mapInArrow(_strengths(lexicon, ["toxic"]), "toxic int, strength double")
    binned = strengths.groupBy(F.round("strength", 2).alias("at")).agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")
    ).orderBy("at").collect()  # bounded by the sample
    at = np.array([0.0, *(r["at"] for r in binned)])
    toxic, clean = (np.array([0, *(r[k] for r in binned)]) for k in ("toxic", "clean"))
    # errors when everything up to bin i counts as clean
    wrong = np.cumsum(toxic) + clean.sum() - np.cumsum(clean)
    i = int(np.flatnonzero(wrong == wrong.min())[0])
    above = at[i + 1] if i + 1 < len(at) else at[i] + 1.0
    return Lexicon(lexicon.words, lexicon.beginnings, lexicon.exceptions, max((at[i] + above) / 2, 1e-3))


def _strengths(lexicon: Lexicon, keep: list[str], score: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for part in chunks(batch):
                values = np.array([matcher.strength(t) for t in part.column("text").to_pylist()], float)
                if score:
                    values = 1 / (1 + np.exp(-np.clip(4 * (values / lexicon.middle - 1), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(values)], names=[*keep, "score" if score else "strength"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1; 0.5 is where a text is as likely toxic as not."""
    keep = [c for c in docs.columns if c != "score"]
    frame = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [f"c{i}" for i in range(len(keep))]
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=True)]
    out = frame.toDF(*names).withColumn("text", F.col(names[keep.index(text)])).mapInArrow(_strengths(lexicon, names, True), ", ".join([*fields, "score double"]))
    return out.toDF(*keep, "score")
