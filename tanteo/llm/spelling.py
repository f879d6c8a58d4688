"""Spelling variants: vocabulary acceptor, one-edit transducer and vocabulary acceptor, composed.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased in A-Z only, of ``LEAST`` code points and ``TWICE`` occurrences or
more; two are near if exactly one code point is inserted, deleted or replaced. Their pairs are the paths that the composition
acceptor . one-edit transducer . acceptor accepts. Until its edit the transducer copies, so both acceptors are in one state; behind
it they must read the same rest, which in a minimised acceptor they mostly do by meeting in one state again.

The acceptor of all words is too large for a task. It is cut at initial states: the state behind the first three letters, for all
edits after them (P), and, for edits among them, the state from which both words go on alike: words with equal letters behind the
third (replaced) or the fourth (the longer of two, S). In each cut a minimal acceptor is built from the letters that are left, and
accepted pairs are enumerated. Each pair is accepted in one cut only, at the last place its inserted letter can be put at.

A cut of more than ``BOUND`` words is cut deeper: P at longer prefixes, with the edits at the places between by themselves (R:
replaced there, I: inserted there), S into its places; those last cuts hold at most one word per letter. Words of 64 code points
and more are cut into blocks of 32 letters (L; M for the pairs of 64 and 65), keyed by digests of what lies around the block.

Result of ``grouped``: a row per word with ``n``, ``n_near``, ``form``, ``form_n`` and ``root``: the form is the near word with the
largest ``n`` (ties: the smallest in code-point order) if that is ``TIMES`` times the word's or more, the root the end of the chain
of forms, of the word itself if it has none. Null texts have no words; repeated rows and copies count as often as they stand.
Other columns are never read. Empty tables give an empty table.

``misspelled`` gives the runs: where a checksum of ``<doc_id>:<run>`` divides by ``every``, one letter of the run is taken out, so
that the corpus holds known variants (``every`` None: runs as they stand). A null id counts as an empty string there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.llm.store import stored

LEAST, TWICE, TIMES = 7, 2, 10
BOUND = 20_000
LONG, BLOCK, HEAD = 64, 32, 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROWS = "pid string, region string, role int, word string, n bigint"


class Acceptor:
    """The minimal deterministic acceptor of sorted, different words; state 0 is the initial one."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def close(depth: int) -> None:
            # states behind ``depth`` get no more arcs: each is replaced by an equal one that is known
            for d in range(len(last), depth, -1):
                state = path[d]
                same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                if same != state:
                    self.arcs[path[d - 1]][last[d - 1]] = same
            del path[depth + 1 :]

        for word in words:
            depth = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                depth += 1
            close(depth)
            for letter in word[depth:]:
                self.arcs[path[-1]][letter] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = word
        close(0)


class OneEdit:
    """The composition of an acceptor, the one-edit transducer and the acceptor again."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.arcs, self.final = acceptor.arcs, acceptor.final
        self._meet: dict[tuple[int, int], bool] = {}
        self._here: dict[int, tuple[list, list]] = {}
        self._below: dict[int, bool] = {}

    def meet(self, p: int, q: int) -> bool:
        """Whether some word is accepted from both states."""
        if p == q or self.final[p] and self.final[q]:
            return True
        key = (p, q) if p < q else (q, p)
        found = self._meet.get(key)
        if found is None:
            one, two = self.arcs[p], self.arcs[q]
            if len(one) > len(two):
                one, two = two, one
            found = self._meet[key] = any(a in two and self.meet(to, two[a]) for a, to in one.items())
        return found

    def rests(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """The words accepted from both states, but those that begin with ``but``."""
        if self.final[p] and self.final[q]:
            yield ""
        for a, to in self.arcs[p].items():
            other = self.arcs[q].get(a)
            if a != but and other is not None and self.meet(to, other):
                for rest in self.rests(to, other):
                    yield a + rest

    def here(self, state: int) -> tuple[list, list]:
        """The edits that lead on from ``state`` in both acceptors: replaced letters and inserted ones."""
        found = self._here.get(state)
        if found is None:
            arcs = list(self.arcs[state].items())
            replaced = [(a, b, p, q) for i, (a, p) in enumerate(arcs) for b, q in arcs[i + 1 :] if self.meet(p, q)]
            inserted = [(b, q) for b, q in arcs if next(self.rests(state, q, b), None) is not None]
            found = self._here[state] = (replaced, inserted)
        return found

    def below(self, state: int) -> bool:
        """Whether any edit is accepted at the state or behind it."""
        found = self._below.get(state)
        if found is None:
            found = self._below[state] = any(self.here(state)) or any(self.below(to) for to in self.arcs[state].values())
        return found

    def pairs(self, state: int = 0, read: str = "") -> Iterator[tuple[str, str]]:
        replaced, inserted = self.here(state)
        for a, b, p, q in replaced:
            for rest in self.rests(p, q):
                yield read + a + rest, read + b + rest
        for b, q in inserted:
            for rest in self.rests(state, q, b):
                yield read + rest, read + b + rest
        for a, to in self.arcs[state].items():
            if self.below(to):
                yield from self.pairs(to, read + a)


def _of_cut(kind: str, regions: list[str], roles: list[int]) -> Iterator[tuple[int, int]]:
    """Accepted pairs of one cut, as places in its sorted regions."""
    at = {r: i for i, r in enumerate(regions)}
    size = {"S": HEAD, "L": BLOCK, "M": BLOCK}.get(kind)
    for one, two in OneEdit(Acceptor(regions)).pairs():
        i, j = at[one], at[two]
        if size is not None and (roles[i] and roles[j] or one[:size] == two[:size]) or kind in "IM" and roles[i] == roles[j]:
            continue
        yield i, j


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n) of every accepted pair, both ways; the rows of a cut follow each other, regions sorted."""
    held: list[pa.RecordBatch] = []
    names = ["word", "n", "near", "near_n"]

    def cut(table: pa.Table, starts: list[int], ends: list[int]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for start, end in zip(starts, ends, strict=True):
            if end - start < 2:
                continue
            rows = table.slice(start, end - start)
            kind = rows.column("pid")[0].as_py()[0]
            words, n = rows.column("word").to_pylist(), rows.column("n").to_pylist()
            for i, j in _of_cut(kind, rows.column("region").to_pylist(), rows.column("role").to_pylist()):
                found += (words[i], n[i], words[j], n[j]), (words[j], n[j], words[i], n[i])
                if len(found) > 1 << 15:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)))
                    found = []
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)))

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pc.run_end_encode(table.column("pid").combine_chunks()).run_ends.to_pylist()
        starts = [0, *ends[:-1]]
        yield from cut(table, starts[:-1], ends[:-1])
        held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from cut(table, [0], [table.num_rows])


def misspelled(docs: DataFrame, every: int | None = None, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word): the runs of letters of all texts with ``least`` code points or more (module docstring)."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _UPPER.lower()), F.lit("[a-z\\u00C0-\\u00FF]+"), 0)
    found = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= least)).alias("run"))
    if every is not None:
        sums = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (sums % F.length("run")).cast("int")
        shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        found = found.withColumn("run", F.when(sums % every == 0, shorter).otherwise(F.col("run"))).where(F.length("run") >= least)
    return found.select(F.col("run").alias("word"))


def _by_place(words: DataFrame, places, roles: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows of the cuts of single places (R and I): words with one letter left out, and the shorter words themselves."""
    placed = words.withColumn("i", F.explode(places)).where(F.col("i") <= F.length("word"))
    letter, after = F.col("word").substr(F.col("i") + 1, F.lit(1)), F.col("word").substr(F.col("i") + 2, F.lit(1))
    rest = F.concat(F.col("word").substr(F.lit(1), F.col("i")), F.col("word").substr(F.col("i") + 2, F.length("word")))
    row = lambda kind, key, region, role: F.struct(
        F.concat(F.lit(kind), F.col("i").cast("string"), F.lit(":"), key).alias("pid"), region.alias("region"), F.lit(role).alias("role"))
    inside = F.col("i") < F.length("word")
    rows = []
    if 0 in roles:
        rows += [F.when(inside, row("R", rest, letter, 0)), row("I", F.col("word"), F.lit(""), 0)]
    if 1 in roles:
        rows.append(F.when(inside & (letter != after), row("I", rest, letter, 1)))
    return placed.select(F.explode(F.array_compact(F.array(*rows))).alias("r"), "word", "n").select("r.*", "word", "n")


def _parted(rows: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cuts of at most ``bound`` words, and those of larger ones (None if there are none)."""
    large = stored(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bound).select("pid"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, "pid", "left_anti"), rows.join(large, "pid", "left_semi")


def cuts(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """(pid, region, role, word, n) of every cut; ``words`` has each word once with its ``n``. Of words of more than 64 code points
    ``word`` is ``#`` and a digest."""
    columns = ["pid", "region", "role", "word", "n"]
    short = words.where(F.length("word") <= LONG)
    part = lambda a, b=None: F.col("word").substr(F.lit(a + 1), F.length("word") if b is None else F.lit(b - a))
    out = []
    now, depth, step = short, HEAD, 1
    while True:
        rows = now.select(F.concat(F.lit(f"P{depth}:"), part(0, depth)).alias("pid"), part(depth).alias("region"), F.lit(0).alias("role"), "word", "n")
        fine, large = _parted(rows, bound)
        out.append(fine)
        if large is None:
            break
        now = stored(large.select("word", "n"))
        out.append(_by_place(now, F.sequence(F.lit(depth), F.lit(depth + step - 1))))
        depth, step = depth + step, step * 2
    heads = F.explode(F.array(*[
        F.struct(F.concat(F.lit("S"), part(HEAD + role)).alias("pid"), part(0, HEAD + role).alias("region"), F.lit(role).alias("role")) for role in (0, 1)
    ])).alias("r")
    fine, large = _parted(short.select(heads, "word", "n").select("r.*", "word", "n"), bound)
    out.append(fine)
    if large is not None:
        large = stored(large)
        out += [_by_place(large.where(F.col("role") == role).select("word", "n"), F.sequence(F.lit(0), F.lit(HEAD - 1)), (role,)) for role in (0, 1)]
    out.append(_long_cuts(words.where(F.length("word") >= LONG)))
    rows = out[0].select(*columns)
    for more in out[1:]:
        rows = rows.unionByName(more.select(*columns))
    return rows


def _long_cuts(words: DataFrame) -> DataFrame:
    rows = []
    for role in (0, 1):
        # ``size`` is the length of the shorter word of a pair: the word's own, or one less
        sized = words.withColumn("size", F.length("word") - role).where(F.col("size") >= LONG)
        rows.append(sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size"), F.lit(BLOCK)))).withColumn("role", F.lit(role)))
    placed = rows[0].unionByName(rows[1])
    cut = lambda a, n: F.col("word").substr(a, n)
    before, behind = cut(F.lit(1), F.col("at")), cut(F.col("at") + BLOCK + F.col("role") + 1, F.length("word"))
    pid = F.concat(F.when(F.col("size") == LONG, "M").otherwise("L"), "size", F.lit(":"), "at", F.lit(":"), F.md5(F.concat(before, F.lit("|"), behind)))
    return placed.select(pid.alias("pid"), cut(F.col("at") + 1, F.col("role") + BLOCK).alias("region"), "role", _name("word").alias("word"), "n")


def _name(word: str):
    return F.when(F.length(word) > LONG, F.concat(F.lit("#"), F.md5(word))).otherwise(F.col(word))


def near_pairs(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """(word, n, near, near_n) for every near pair, both ways."""
    cut = cuts(words, bound).repartition("pid").sortWithinPartitions("pid", "region")
    found = cut.mapInArrow(_accepted, "word string, n bigint, near string, near_n bigint")
    spelled = words.where(F.length("word") > LONG).select(_name("word").alias("name"), F.col("word").alias("spelled"))
    found = stored(found)
    is_long = F.col("word").startswith("#") | F.col("near").startswith("#")
    long = found.where(is_long).join(spelled, F.col("word") == F.col("name"), "left").select(F.coalesce("spelled", "word").alias("word"), "n", "near", "near_n")
    long = long.join(spelled, F.col("near") == F.col("name"), "left").select("word", "n", F.coalesce("spelled", "near").alias("near"), "near_n")
    return found.where(~is_long).unionByName(long)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain, by doubling steps. A form stands ``TIMES`` times as often as
    the word, so chains are short and have no ring."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def grouped(runs: DataFrame, twice: int = TWICE, times: int = TIMES, bound: int = BOUND) -> DataFrame:
    """The words among ``runs`` (column ``word``) with their variants (module docstring)."""
    words = stored(runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= twice))
    better = F.when(F.col("near_n") >= F.col("n") * times, F.struct((-F.col("near_n")).alias("order"), "near"))
    found = near_pairs(words, bound).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(better).alias("best"))
    known = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n")))
    roots = _roots(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
