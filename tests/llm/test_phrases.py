"""Mined phrases beside a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tanteo.llm import phrases

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, min_count, limit):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = {}
    for lang, *words in candidates:
        a = f[(lang, *words)]
        cuts = [(2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda big: any(list(big[i : i + len(words)]) == words for i in range(1, len(big) - len(words) + 1))
        if not any(c[0] == lang and len(c) > len(words) + 1 and inside(c) and 100 * f[c] >= 80 * a for c in candidates):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:limit], 1)
    }


def corpus(seed, n):
    source = random.Random(seed)
    vocabulary = ["a", "b", "É", "é", "Zeit", "zeit", "|", "-", "naïve", "x y", "c"]
    rows = []
    for _ in range(n):
        words = source.choices(vocabulary, [9, 7, 2, 2, 3, 3, 1, 1, 2, 1, 5], k=source.randint(0, 60))
        rows.append((source.choice(["en", "de", None, "und", ""]), "".join(w + source.choice([" ", " ", " ", "\t", ".", "\n", ", ", "\r\n"]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " \t. ; "), ("de", "a b a b a b a b c " * 40)] + rows[:5] * 2


def test_phrases_equal_a_plain_count(spark):
    rows = corpus(3, 80)
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, text string, `w1` string, `a.n` int").repartition(3)
    for min_count, limit in ((5, 2000), (12, 7)):
        found = phrases.mined(frame, min_count=min_count, limit=limit)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in found.collect()} == plain(rows, min_count, limit)


def test_a_small_bitmap_changes_nothing(spark, monkeypatch):
    rows = corpus(4, 60)
    frame = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "_frequent", lambda rows, n, pairs=None: np.full(4096, 255, np.uint8))
    assert {tuple(r) for r in phrases.mined(frame, min_count=6).collect()} == plain(rows, 6, 2000)


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mined(empty).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", " \n ")], "lang string, text string")
    assert phrases.mined(blank).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    n = 9_223_372_036_854
    value = spark.sql(f"SELECT (cast(2000000 AS decimal(10,0)) * cast({n}L AS decimal(20,0))) div (cast({n + 1}L AS decimal(20,0)) + cast({n + 7}L AS decimal(20,0))) AS s").first().s
    assert value == 2_000_000 * n // (2 * n + 8)


def test_one_very_long_text_is_split_whole():
    text = "one two, " * 400_000
    found, piece, at = phrases.split_words(pa.array([None, text, ""]))
    assert len(found) == 800_000 and set(at.tolist()) == {1} and len(set(piece.tolist())) == 400_000


def test_slices_of_a_batch_are_split_like_whole_batches():
    texts = pa.array([t for _, t in corpus(7, 30)])
    whole = phrases.split_words(texts)[0].to_pylist()
    assert sum((phrases.split_words(texts.slice(at, 4))[0].to_pylist() for at in range(0, len(texts), 4)), []) == whole
