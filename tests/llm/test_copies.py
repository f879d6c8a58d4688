"""Near copies, repeated passages and benchmark leaks beside brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tanteo.llm import decontamination, ngram_join, substring_dedup
from tanteo.llm.bitmap import bitmap_of
from tanteo.llm.components import components
from tanteo.llm.text import words


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def changed(text, seed, n):
    source, w = random.Random(seed), text.split()
    for at in source.sample(range(len(w)), n):
        w[at] = f"new{seed}x{at}"
    return " ".join(w)


def test_word_hashes_are_those_of_the_words():
    texts = [None, "", " a  b\tÄ ", "a", "x b", "ä b a"]
    hashed, begins = words(pa.array(texts))
    spelled = [w for t in texts for w in (t or "").lower().split()]
    assert np.diff(begins).tolist() == [len((t or "").split()) for t in texts]
    assert all((hashed[i] == hashed[j]) == (a == b) for (i, a), (j, b) in itertools.combinations(enumerate(spelled), 2))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_bands_reach_the_wanted_recall():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MAX_HASHES


def test_links_equal_brute_force(docs, prose):
    base = [prose(120, s) for s in range(6)]
    texts = [t for b in base for t in (b, b, changed(b, 1, 2), changed(b, 2, 4), changed(b, 3, 12))]
    # one large group of near copies, over several blocks
    texts += [changed(prose(200, 50), s, 1) for s in range(70)] + [None, "", "one two", "one two", prose(4, 7)]
    frame = docs(*texts)
    pairs = {}
    kinds = sorted({t or "" for t in texts})
    for a, b in itertools.combinations(kinds, 2):
        one, two = grams(a), grams(b)
        if one and two and 10 * len(one & two) >= 8 * len(one | two):
            pairs.setdefault(a, set()).add(b)
            pairs.setdefault(b, set()).add(a)
    rows = ngram_join.joined(frame).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_links, r.n_copies) == (len(pairs.get(r.text or "", ())), sum((t or "") == (r.text or "") for t in texts))
    degrees, _ = ngram_join.links(frame, block=32)
    assert sorted(n for _, n in degrees.collect()) == sorted(len(v) for v in pairs.values())
    kept = {r.doc_id for r in ngram_join.one_of_each(frame).collect()}
    assert kept == {r.class_id for r in rows}
    assert ngram_join.joined(frame.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_leave_one(spark, prose):
    frame = spark.createDataFrame([(1, prose(60, 1)), (1, prose(60, 1)), (None, prose(60, 2)), (None, prose(60, 2)), (2, prose(60, 3))], "doc_id bigint, text string")
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(frame).collect()) == [0, 1, 2]


def test_fuzzy_passages_are_found(docs, prose):
    passage = prose(70, 5)
    texts = [
        f"{prose(100, 1)} {passage} {prose(50, 2)}", f"{prose(30, 3)} {changed(passage, 1, 3)} {prose(90, 4)}",
        f"{changed(passage, 2, 2)}", prose(200, 9), prose(200, 10), prose(200, 9), None, "", "same line here again " * 300,
    ]
    rows = {r.doc_id: r for r in substring_dedup.repeats(docs(*texts)).collect()}
    assert len(rows) == len(texts)
    touched = {i for i, r in rows.items() if r.spans or r.n_first_words}
    assert touched == {0, 1, 2}
    assert sum(bool(rows[i].spans) for i in (0, 1, 2)) == 2
    for i in (0, 1, 2):
        for s in rows[i].spans:
            assert 45 <= s.end - s.start <= 80 and s.doc_id in (0, 1, 2)
    assert (rows[5].copy_of, rows[3].copy_of, rows[7].copy_of) == (3, None, 6)
    assert substring_dedup.repeats(docs(*texts).limit(0)).count() == 0


def test_passages_of_frequent_phrases_are_found(spark, docs, prose):
    shared = prose(60, 110).split()
    texts = [f"{prose(30, 111)} {' '.join(shared)} {prose(30, 112)}", f"{prose(50, 113)} {' '.join(shared)} {prose(20, 114)}"]
    key = lambda text: (xxhash.xxh64_intdigest(text, 42) ^ 1 << 63) - (1 << 63)
    least = min(map(key, texts))
    # every run of 8 words, and every pair of neighbouring seeds, stands in a text with a smaller key that repeats no passage
    for at in range(0, 31, 6):
        snippet = " ".join(shared[at : at + 30])
        texts.append(next(t for n in itertools.count() if key(t := f"{snippet} end{at}x{n}") < least))
    rows = {r.doc_id: r for r in substring_dedup.repeats(docs(*texts)).collect()}
    spans = [(i, s.end - s.start, s.doc_id) for i, r in rows.items() for s in r.spans]
    assert len(spans) == 1 and spans[0][1] == 60 and {spans[0][0], spans[0][2]} == {0, 1}


def test_chain_scores_equal_brute_force():
    source = random.Random(2)
    for _ in range(60):
        seeds = sorted({(source.randint(0, 60), source.randint(0, 60)) for _ in range(9)})
        here, there = np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds])
        best = 0.0
        for n in range(1, len(seeds) + 1):
            for part in itertools.combinations(seeds, n):
                gaps = list(zip(part, part[1:], strict=False))
                # disjoint seeds only: there the score is plain words less gaps
                if all(b[0] - a[0] >= 8 and b[1] - a[1] >= 8 for a, b in gaps):
                    best = max(best, 8 * n - sum(0.1 * (b[0] - a[0] - 8 + b[1] - a[1] - 8) for a, b in gaps))
        found = substring_dedup.chains(here, there)
        assert max(c[4] for c in found) >= best - 1e-9
        assert sum(c[1] - c[0] >= 8 for c in found) == len(found)


def test_common_subsequence():
    source = random.Random(4)
    for _ in range(200):
        a, b = ([source.choice("abc") for _ in range(source.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substring_dedup.common_words(a, b) == table[-1][-1]
        if a:
            code = {c: i for i, c in enumerate("abc")}
            share = decontamination.common_share(np.array([code[c] for c in a]), np.array([code[c] for c in b], int))
            assert abs(share - table[-1][-1] / len(a)) < 1e-9


def test_leaks_and_paraphrases(spark, docs, prose):
    items = [(1, prose(16, 201), 0), (2, prose(40, 202), 0), (3, prose(59, 203), 0), (4, None, 0), (5, "too short", 0)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string, leaks int")
    texts = [prose(300, s) for s in range(60)]
    texts[7] = f"{prose(90, 70)} {items[0][1]} {prose(40, 71)}"
    texts[8] = f"{prose(13, 72)} {changed(items[1][1], 5, 8)} {prose(400, 73)}"
    texts[9] = items[2][1]
    texts += [None, "", texts[9]]
    frame = docs(*texts)
    rows = decontamination.marked(frame, benchmark).collect()
    assert {(r.doc_id, leak.item_id) for r in rows for leak in r.leaks} == {(7, 1), (8, 2), (9, 3), (62, 3)}
    clean = decontamination.clean(frame, benchmark)
    assert clean.columns == frame.columns and clean.count() == len(texts) - 4
    assert decontamination.marked(frame.limit(0), benchmark).count() == 0
    assert decontamination.marked(frame, benchmark.limit(0)).where("size(leaks) > 0").count() == 0


def test_items_in_most_documents_are_found(spark, docs, prose):
    items = [(1, prose(30, 301)), (2, " ".join(random.Random(5).choices(prose(12, 302).split(), k=24)))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    # item 1 stands in a third of the documents, all words of item 2 in every one
    texts = [f"{prose(60, s)} {prose(12, 302)} {items[0][1] if s % 3 == 0 else ''} {prose(60, 900 + s)}" for s in range(400, 430)]
    texts[5] += " " + items[1][1]
    rows = decontamination.marked(docs(*texts), benchmark).collect()
    found = {(r.doc_id, leak.item_id) for r in rows for leak in r.leaks}
    assert found == {(i, 1) for i in range(30) if (400 + i) % 3 == 0} | {(5, 2)}


def test_copies_beside_shuffled_words_long_and_short_items_are_found(spark, docs, prose):
    items = [(1, prose(48, 501)), (2, prose(400, 502)), (3, "three short words"), (4, " "), (5, "")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [prose(300, s) for s in range(600, 630)]
    # one run of near passages: the words in other orders, and between them the item without every fourth word
    w, source = items[0][1].split(), random.Random(9)
    copy = " ".join(x for i, x in enumerate(w) if i % 4 != 3)
    texts[3] = " ".join([*(x for _ in range(3) for x in source.sample(w, 48)), copy, *(x for _ in range(3) for x in source.sample(w, 48))])
    texts[4] = " ".join(x for _ in range(6) for x in source.sample(w, 48))
    # every third word of the long item replaced: no five words in a row are left
    texts[5] = f"{prose(200, 503)} {' '.join(f'other{i}' if i % 10 in (2, 5, 8) else x for i, x in enumerate(items[1][1].split()))} {prose(200, 504)}"
    texts[6] += " Three short words and more"
    texts[7] += " three words short"
    # latent vectors that are alike in strength, whatever the few texts here share
    vectors = np.random.default_rng(3).standard_normal((decontamination.TERMS, 64)).astype(np.float16)
    searched = decontamination._items(benchmark.collect(), vectors, np.ones(decontamination.TERMS))
    rows = decontamination.searched(docs(*texts), searched, vectors).collect()
    assert {(r.doc_id, leak.item_id) for r in rows for leak in r.leaks} == {(3, 1), (5, 2), (6, 3)}


def test_the_first_leak_is_that_of_asking_every_passage():
    source = random.Random(41)
    for _ in range(300):
        word_at = [source.random() < 0.4 for _ in range(120)]
        n = source.randint(1, 20)
        starts = [source.randint(0, 100) for _ in range(n)]
        stops = [s + source.randint(5, 20) for s in starts]
        need = source.randint(1, 12)
        asked = []

        def leaks(a, b, word_at=word_at, need=need, asked=asked):
            asked.append((a, b))
            return sum(word_at[a:b]) >= need

        wanted = next((i for i in range(n) if sum(word_at[starts[i] : stops[i]]) >= need), -1)
        assert decontamination.first_leak(starts, stops, leaks) == wanted
        assert wanted or len(asked) == 1


def test_cells_hold_every_leak_and_few_others(spark, prose):
    source = random.Random(61)
    common = prose(40, 700).split()
    rows = [Row(item_id=n, text=" ".join(x if source.random() < 0.8 else source.choice(common) for x in prose(size, 710 + n).split()))
            for n, size in enumerate([5, 9, 20, 30, 59, 64, 130, 300] * 4)]
    vectors = np.zeros((decontamination.TERMS, 4), np.float16)
    items = decontamination._items(rows, vectors, np.random.default_rng(7).random(decontamination.TERMS))
    texts = [" ".join(source.choices(common, k=n)) for n in (0, 3, 40, 400, 1500)]
    for r in rows:
        own = [x if source.random() < 0.75 else "changed" for x in r.text.split()]
        texts.append(" ".join([*source.choices(common, k=source.randint(0, 300)), *own, *source.choices(common, k=source.randint(0, 300))]))
    hashed, offsets = words(pa.array(texts))
    possible = decontamination._possible(items, hashed, offsets)
    leaks = others = 0
    for group, (begins, may) in zip(items.cells, possible, strict=True):
        for k, item in enumerate(group.items.tolist()):
            n = len(items.hashed[item])
            blocks = int(items.blocks[items.part_of == item][0])
            around = decontamination._around(n, blocks)
            for doc, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
                places = [(max(0, p - around), p + 8 * blocks + around) for p in range(0, b - a, 8)]
                # also where an item begins at any word
                places += [(max(0, p - 8), p + n + 8) for p in range(0, b - a, 13)]
                for start, stop in places:
                    passage = hashed[a:b][start:stop]
                    share = decontamination.common_share(items.hashed[item], passage)
                    leak = share >= 0.7 or (share >= 0.5 and np.isin(items.rare[item], passage).mean() >= 0.6)
                    leaks += leak
                    assert not leak or may[begins[doc] + start // group.size, k]
            others += int(may[:, k].sum())
    assert leaks > 100 and others < sum(may.size for _, may in possible) // 10


def test_columns_of_any_name_stay(spark, prose):
    rows = [(1, prose(60, 1), "k", 2, 3.0, "d"), (2, prose(60, 1), "k", 2, 3.0, "d"), (3, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, _key string, root int, `a.b` double, _digest string")
    found = ngram_join.joined(frame)
    assert found.columns == [*frame.columns, "class_id", "n_links", "n_copies"]
    assert sorted(tuple(r)[:6] for r in found.collect()) == rows and [r.class_id for r in found.orderBy("doc_id").collect()] == [1, 1, 3]
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_seeds_of_one_text_stay_and_near_chains_share_a_row(spark, prose):
    shared = prose(60, 810)
    texts = [f"{prose(200, 811)} {shared} {prose(200, 812)}", f"{prose(100, 813)} {shared} {prose(300, 814)}", prose(500, 815)]
    frame = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "text string")
    every = substring_dedup._seeds(frame, "text").select("seed", "key").distinct()
    often = every.groupBy("seed").count().where("count > 1")
    sent = spark.sparkContext.broadcast(bitmap_of(often, "seed"))
    left = substring_dedup._seeds(frame, "text", sent)
    assert left.where("not equal").select("seed").distinct().join(often, "seed").count() == often.count()
    assert 10 * left.where("not equal").count() < 5 * every.count()
    # the runs of 40 words of a passage of 60, in two texts and a copy
    assert left.where("equal").groupBy("seed").agg(F.countDistinct("key").alias("n")).where("n = 2").count() == 21
    rows = [(head, there, at, equal) for head in (5, 6) for at, there, equal in [
        *((100 + i, 50 + i, True) for i in range(21)), (104, 54, False), (118, 68, False), (200, 150, False), (900, 850, False), (960, 20, False)]]
    table = pa.table({
        "key": pa.array([7] * len(rows), pa.int64()), "head": pa.array([r[0] for r in rows], pa.int64()), "there": pa.array([r[1] for r in rows], pa.int32()),
        "at": pa.array([[r[2]] for r in rows], pa.list_(pa.int32())), "equal": [r[3] for r in rows],
    })
    found = [(r["key"], r["head"], [(x["a"], x["b"], x["c"], x["d"]) for x in r["found"]]) for r in substring_dedup._chained(table).to_pylist()]
    near = [(100, 160, 50, 110), (200, 208, 150, 158)]
    assert found == [(7, h, x) for h in (5, 6) for x in (near, [(900, 908, 850, 858)], [(960, 968, 20, 28)])]


def test_every_run_that_two_texts_have_may_be_repeated(spark, prose):
    """The bitmap lets all shared runs of words through, and few others."""
    source = random.Random(51)
    texts = [prose(300, s) for s in range(12)]
    for _ in range(10):
        i, j = source.sample(range(12), 2)
        a, b = (texts[k].split() for k in (i, j))
        at, n = source.randint(0, 200), source.randint(40, 90)
        texts[j] = " ".join([*b[: source.randint(0, len(b))], *a[at : at + n], *b[-source.randint(0, 50) :]])
    texts += ["", "one two", " ".join(texts[0].split()[:40]), "x " * 100]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    seeds = substring_dedup._seeds(frame, "text")
    often = seeds.groupBy("seed").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b")
    bitmap = bitmap_of(often, "seed")
    hashed, offsets = words(pa.array(texts))
    found = substring_dedup.repeatable(hashed, offsets, bitmap)
    runs = {}
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        for p in range(a, b - 39):
            runs.setdefault(tuple(hashed[p : p + 40].tolist()), set()).add(i)
    begins, shared = substring_dedup.grams_begin(offsets, 40), 0
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        for n, p in enumerate(range(a, b - 39)):
            if len(runs[tuple(hashed[p : p + 40].tolist())]) > 1:
                shared += 1
                assert found[begins[i] + n]
    assert shared > 100 and found.sum() < 2 * shared + 100 and len(found) == begins[-1]
