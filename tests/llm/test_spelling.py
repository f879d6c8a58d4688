"""Variants beside a plain comparison of all words."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

from tanteo.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=10):
    pairs = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            pairs[a].append(b)
            pairs[b].append(a)
    form = {}
    for w, others in pairs.items():
        if others and counts[best := min(others, key=lambda o: (-counts[o], o))] >= times * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(pairs[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def vocabulary(seed, n, letters="abcé", longest=13):
    source = random.Random(seed)
    out = Counter()
    while len(out) < n:
        word = "".join(source.choice(letters) for _ in range(source.randint(7, longest)))
        for _ in range(source.randint(1, 6)):
            out[word] = source.choice([2, 3, 20, 40, 200, 2000])
            at = source.randint(0, len(word))
            word = source.choice([word[:at] + source.choice(letters) + word[at:], word[:at] + source.choice(letters) + word[at + 1 :]])
    return {w: n for w, n in out.items() if len(w) >= 7}


def pairs_of(spark, counts, bound):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = [(r.word, r.n, r.near, r.near_n) for r in spelling.near_pairs(words, bound).collect()]
    assert len(found) == len(set(found))
    assert all(counts[a] == n and counts[b] == m for a, n, b, m in found)
    return {(a, b) for a, _, b, _ in found}


def test_the_acceptor_is_minimal_and_accepts_its_words():
    words = sorted(vocabulary(1, 300))
    machine = spelling.Acceptor(words)
    reached, todo = {0}, [0]
    while todo:
        new = set(machine.arcs[todo.pop()].values()) - reached
        reached |= new
        todo += new
    rights = [frozenset(_right(machine, q)) for q in reached]
    assert _right(machine, 0) == set(words) and len(set(rights)) == len(rights)


def _right(machine, q):
    return ({""} if machine.final[q] else set()) | {a + r for a, to in machine.arcs[q].items() for r in _right(machine, to)}


def test_pairs_equal_brute_force_at_every_bound(spark):
    counts = vocabulary(2, 500)
    wanted = {(a, b) for a, b in itertools.permutations(counts, 2) if abs(len(a) - len(b)) <= 1 and near(a, b)}
    assert len(wanted) > 500
    for bound in (20_000, 30, 2):
        assert pairs_of(spark, counts, bound) == wanted


def test_long_words_and_repeated_letters(spark):
    source = random.Random(4)
    counts = {"a" * k: k for k in range(7, 140)}
    for size in (62, 63, 64, 65, 66, 95, 96, 97, 128, 300):
        word = "".join(source.choice("ab") for _ in range(size))
        for at in [0, 1, 2, 3, size // 2, size - 1, size, *source.sample(range(size), 5)]:
            counts |= {word: 2, word[:at] + "x" + word[at:]: 3, word[:at] + "y" + word[at + 1 :]: 4, word[:at] + word[at + 1 :]: 5}
    counts["b" * 50_000] = counts["b" * 25_000 + "c" + "b" * 24_999] = 9
    wanted = {(a, b) for a, b in itertools.permutations(counts, 2) if abs(len(a) - len(b)) <= 1 and near(a, b)}
    for bound in (20_000, 20):
        assert pairs_of(spark, counts, bound) == wanted


def test_words_forms_and_roots_equal_brute_force(spark):
    source = random.Random(5)
    lower = {c: c + 32 for c in range(65, 91)}
    words = [w.upper() if source.random() < 0.1 else w for w in vocabulary(6, 150)]
    texts = [" ".join(source.choices(words, [1 / (i + 1) ** 1.3 for i in range(len(words))], k=400)) + source.choice([" short", "É1élevées÷abc", "_x"]) for _ in range(60)]
    rows = [(i - 5, t, "x", 1) for i, t in enumerate(texts)] + [(99, None, "x", 1), (98, "", None, 1), (None, texts[0], "y", 2), (7, texts[12], "x", 1), (7, texts[12], "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, word string, `n.n` int")
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    wanted = plain(counts)
    assert sum(r[3] is not None for r in wanted) > 20
    found = spelling.grouped(spelling.misspelled(frame, every=31))
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {tuple(r) for r in found.collect()} == wanted


def test_chains_of_forms_end_at_the_root(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "abcdefghix": 2000, "zzzzzzzz": 5}
    runs = spark.createDataFrame([(w,) for w, n in chain.items() for _ in range(n)], "word string")
    assert {tuple(r) for r in spelling.grouped(runs).collect()} == plain(chain)


def test_empty_tables_give_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, "tiny words")]):
        assert spelling.grouped(spelling.misspelled(spark.createDataFrame(rows, "doc_id bigint, text string"))).count() == 0
