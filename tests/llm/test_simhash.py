"""Fingerprints and components beside plain statements of both."""

from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash

from tanteo.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(rows):
    """The smallest id of each row's component, by links between all pairs of fingerprints."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in rows]


def near_copies(prose, n, seed):
    source, base = random.Random(seed), prose(400, seed).split()
    out = []
    for _ in range(n):
        words = list(base)
        for at in source.sample(range(len(words)), source.randint(1, 3)):
            words[at] = f"x{source.randint(0, 99)}"
        out.append(" ".join(words))
    return out


def test_fingerprints_and_components_equal_brute_force(spark, prose):
    texts = near_copies(prose, 60, 1) + near_copies(prose, 20, 2) + [prose(50, s) for s in range(30, 60)]
    texts += [None, "", " \t\n", "One", "one", "one TWO", "Éa éb éc", "éa éb éc", "a\x0bb\x0cc", "a b c", "a b c d"] + texts[:7]
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(3, texts[3], "x", 0.5), (None, texts[0], None, None), (None, prose(9, 9), None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, `component_id` double").repartition(3)
    for cell in (1024, 8):
        found = simhash.linked(frame, cell=cell)
        assert found.columns == ["doc_id", "text", "fp", "fingerprint", "component_id"]
        expected = [(r[0], plain_fingerprint(r[1])) for r in rows]
        wanted = [(i, r[1], f"{f:016x}", c) for r, (i, f), c in zip(rows, expected, plain_components(expected), strict=True)]
        order = lambda r: (r[2], r[0] is None, r[0] or 0, r[1] or "")
        assert sorted(((r.doc_id, r.text, r.fingerprint, r.component_id) for r in found.collect()), key=order) == sorted(wanted, key=order)


def test_every_close_pair_meets_in_a_bucket():
    source = random.Random(5)
    choices = simhash.block_choices()
    for flipped in [source.sample(range(64), 3) for _ in range(500)] + [[0], [63], [10, 11, 21], []]:
        mask = sum(1 << b for b in flipped)
        assert any(all(not mask >> low & ((1 << width) - 1) for low, width in choice) for choice in choices)
    assert len(choices) == 20 and all(30 <= sum(w for _, w in c) <= 34 for c in choices)


def test_planted_fingerprints_are_linked_and_only_they(spark):
    source = random.Random(6)
    prints = set()
    for _ in range(40):
        now = source.getrandbits(64)
        for _ in range(source.randint(1, 12)):
            prints.add(now)
            for b in source.sample(range(64), source.randint(1, 5)):
                now ^= 1 << b
    # one bucket much larger than a cell: equal high bits, random low ones
    prints |= {0xABCD_EF01_2345 << 16 | source.getrandbits(16) for _ in range(300)}
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for _, p in rows], "fp bigint")
    for cell in (1024, 16):
        root = {p: p for _, p in rows}

        def find(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in simhash.links(frame, cell).collect():
            root[find(a % (1 << 64))] = find(b % (1 << 64))
        groups = {}
        for i, p in rows:
            groups.setdefault(find(p), []).append(i)
        assert [min(groups[find(p)]) for _, p in rows] == plain_components(rows)


def test_empty_tables_and_empty_texts(spark):
    schema = "text string, doc_id bigint"
    assert simhash.linked(spark.createDataFrame([], schema)).count() == 0
    found = simhash.linked(spark.createDataFrame([(None, 4), ("", 2), ("  ", 9)], schema), keep_text=False).collect()
    assert {tuple(r) for r in found} == {(i, "0" * 16, 2) for i in (4, 2, 9)}


def test_a_very_long_text_is_hashed_whole():
    text = " ".join(f"w{i}" for i in range(300_000))
    assert simhash.fingerprint(text.encode()) != simhash.fingerprint(text[: len(text) // 2].encode())
    assert simhash.fingerprint(text[:20_000].encode()) == plain_fingerprint(text[:20_000])
