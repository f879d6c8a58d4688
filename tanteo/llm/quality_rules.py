"""Quality rules as a short-circuit cascade whose order comes from measured cost and rejections.

Only DataFrame functions run on the executors. ``estimate`` times each rule on a bounded sample of the whole table and counts what
it rejects there; the rules are then tested in the order of rejections per second. ``kept`` has a stage per rule: the counts that a
rule reads are computed only for rows that no earlier rule rejected. ``judged`` keeps all rows with the counts of ``BASE``; the other
counts are null where an earlier rule had rejected the row, and ``failed_rule`` names the first rule that did. The verdict does not
depend on the order.

A null text has no words and is rejected. Repeated rows are judged one by one. Extra columns stay, whatever their names; columns of
``measured`` and ``judged`` replace columns of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.llm.store import stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of the sample on which the rules are timed. It bounds the work of the estimate; the verdict doesn't depend on it.
SAMPLE_ROWS = 500


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more.

    Windows with equal hashes are found by sorting; only those are then compared as text, so the count is exact.
    """

    def hashed(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("window"), i.alias("at")),
        )

    def spelled(w: Column, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["at"] + 1, 3)).alias("window"), x["at"].alias("at")))

    def repeated(windows: Column) -> Column:
        same = lambda s, x, j: F.coalesce(F.get(s, j)["window"] == x["window"], F.lit(False))
        return _let(F.sort_array(windows), lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(
            3 + F.aggregate(
                F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: F.least(b - a, F.lit(3))),
                F.lit(0), lambda total, step: total + step,
            )
        )

    found = _let(words, lambda w: F.when(F.size(w) >= 4, _let(
        F.array_sort(F.transform(repeated(spelled(w, repeated(hashed(w)))), lambda x: x["at"])), covered
    )).otherwise(F.lit(0)))
    return found.cast("long")


#: What several counts read: the words, the text without blanks, and its letters. Each is computed once and carried along.
_PARTS = {"q_words": (), "q_packed": (), "q_letters": ("q_packed",)}
_READS = {
    "n_words": ("q_words",), "n_repeat_words": ("q_words",), "word_chars": ("q_packed",), "n_letters": ("q_letters",), "n_upper": ("q_letters",),
}


def _counts(text: Column) -> dict[str, Column]:
    """What the rules read, over whole texts, and the parts that several of them read; by name in the columns of the frame."""
    whole = F.coalesce(text, F.lit(""))
    has_word = f"[^{''.join(f'\\x{ord(c):02x}' for c in WHITE)}]"
    lines = _let(F.filter(F.split(whole, "\n"), lambda line: line.rlike(has_word)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "q_words": _words(whole),
        "q_packed": F.translate(whole, WHITE, ""),
        "q_letters": F.translate("q_packed", "".join(map(str, range(10))) + SYMBOLS + "!?.,;:'\"()[]{}-_=+/\\@^~`", ""),
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.length("q_packed").cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": lines.cast("long"),
        "n_repeat_words": _repeat_words(F.col("q_words")),
        "n_lines": F.size(F.split(whole, "\n")).cast("long"),
        "n_letters": F.length("q_letters").cast("long"),
        "n_upper": (F.length("q_letters") - F.length(F.regexp_replace("q_letters", "\\p{Lu}", ""))).cast("long"),
    }


def _steps(needs: Sequence[str], known: set[str]) -> list[list[str]]:
    """What must be added for the counts ``needs``, in steps that read earlier ones; ``known`` grows by it."""
    parts = list(dict.fromkeys(p for name in needs for part in _READS.get(name, ()) for p in (*_PARTS[part], part)))
    steps = [[p] for p in parts if p not in known] + [[name for name in needs if name not in known]]
    known |= {*parts, *needs}
    return [step for step in steps if step]


def _placed(docs: DataFrame, text: str) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """``docs`` with its columns named by position, those names, and the counts of its text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, _counts(F.col(names[docs.columns.index(text)]))


def _named(out: DataFrame, docs: DataFrame, added: Sequence[str]) -> DataFrame:
    """The columns of ``docs`` and ``added``, which replace columns of the same name."""
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in added]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in kept], *added)


def measured(docs: DataFrame, text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the five counts of ``BASE`` and three more that the rules read (or ``only`` some of them)."""
    out, _, counts = _placed(docs, text)
    wanted = [name for name in counts if name not in _PARTS] if only is None else list(only)
    for step in _steps(wanted, set()):
        out = out.withColumns({name: counts[name] for name in step})
    return _named(out, docs, wanted)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the counts that it ``needs``."""

    name: str
    rejects: Column
    needs: tuple[str, ...]


def default_rules() -> list[Rule]:
    """Whole-number comparisons, so that every engine agrees on them."""
    n = F.col
    return [
        Rule("few_words", n("n_words") < 50, ("n_words",)),
        Rule("repetition", 100 * n("n_repeat_words") > 50 * n("n_words"), ("n_words", "n_repeat_words")),
        Rule("symbols", 100 * n("n_symbols") > 20 * n("word_chars"), ("n_symbols", "word_chars")),
        Rule("duplicate_lines", 100 * n("n_dup_lines") > 50 * n("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("word_length", (n("word_chars") < 2 * n("n_words")) | (n("word_chars") > 20 * n("n_words")), ("n_words", "word_chars")),
        Rule("few_letters", 100 * n("n_letters") < 50 * n("word_chars"), ("n_letters", "word_chars")),
        Rule("upper_case", 100 * n("n_upper") > 60 * n("n_letters"), ("n_upper", "n_letters")),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    rejected: float
    seconds: float


def estimate(frame: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[Estimate]:
    """Share rejected and seconds of each rule on up to ``rows`` rows, the cheapest rejections first (ties by name).

    Each rule is timed from the raw text on: Spark computes only the counts that the rule reads.
    """
    given = frame.select(F.col(f"`{text}`").alias("text"))
    # rows of every file: twice as many as wanted, of which the first ones are taken
    total = given.count()
    sample = stored((given.sample(min(1.0, 2 * rows / total), seed=1) if total > rows else given).limit(rows))
    found = []
    for rule in rules:
        started = time.perf_counter()
        total, rejected = measured(sample, only=rule.needs).agg(F.count(F.lit(1)), F.count_if(rule.rejects)).first()
        found.append(Estimate(rule.name, rejected / total if total else 0.0, time.perf_counter() - started))
    return sorted(found, key=lambda e: (-e.rejected / e.seconds, e.name))


def _cascade(docs: DataFrame, rules: list[Rule] | None, text: str, sample_rows: int) -> list[Rule]:
    rules = default_rules() if rules is None else rules
    by_name = {rule.name: rule for rule in rules}
    return [by_name[step.name] for step in estimate(docs, rules, sample_rows, text)]


def judged(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with counts, ``failed_rule`` (the first failing rule in cascade order, else null) and ``kept`` (module docstring)."""
    cascade = _cascade(docs, rules, text, sample_rows)
    out, _, counts = _placed(docs, text)
    known: set[str] = set()
    for step in _steps(BASE, known):
        out = out.withColumns({name: counts[name] for name in step})
    out, open_ = out.withColumn("failed_rule", F.lit(None).cast("string")), F.col("failed_rule").isNull()
    for rule in cascade:
        for step in _steps(rule.needs, known):
            out = out.withColumns({name: F.when(open_, counts[name]) for name in step})
        out = out.withColumn("failed_rule", F.when(~open_, F.col("failed_rule")).when(rule.rejects, F.lit(rule.name)))
    added = [name for name in counts if name in known and name not in _PARTS]
    return _named(out.withColumn("kept", open_), docs, [*added, "failed_rule", "kept"])


def kept(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``."""
    out, names, counts = _placed(docs, text)
    known: set[str] = set()
    for rule in _cascade(docs, rules, text, sample_rows):
        for step in _steps(rule.needs, known):
            # a generator of one row: the filters before it stay below, so that rejected rows do not reach it, and those behind above
            out = out.select("*", F.inline(F.array(F.struct(*[counts[name].alias(name) for name in step]))))
        out = out.where(~F.coalesce(rule.rejects, F.lit(False)))
    return out.select(*names).toDF(*docs.columns)
