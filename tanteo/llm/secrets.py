"""Secret scans: all rules in one byte pass of one minimal automaton.

The pass runs over many stretches of text in lockstep: the texts of a slice lie one after the other, cut at bytes behind which the
automaton is in its start state whatever came before, and one array lookup moves all stretches a byte on. It finds which rules
match in which text. There, each such rule's own automaton gives the leftmost-longest matches that do not overlap, and a rule's
check drops matches that are too short.

A null text is an empty one and has no spans. Texts of any length are scanned whole; repeated rows are scanned one by one; extra
columns stay (``spans`` replaces a column of that name). Spans are in code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tanteo.llm.automaton import Automaton, compile_rules
from tanteo.llm.text import chunks

SPAN = "array<struct<kind:string,start:int,end:int>>"
MARK = "[secret]"
#: Stretches that move on together.
_LANES = 4096
#: A byte that UTF-8 never has; it stands between two texts.
_BETWEEN = 0xFF


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    folded: bool = False
    holds: Callable[[bytes], bool] = lambda match: True
    #: What the pass looks for where the whole pattern would multiply the states of the others: a string that begins every match.
    opening: str | None = None


def _long_value(match: bytes) -> bool:
    """The value behind ``:`` or ``=``, blanks and a quote has six characters or more."""
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sign + 1 :].lstrip(b" ")
    return len(value) - value.startswith((b"'", b'"')) >= 6


RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=\\-]+", True, _long_value, "(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=\\-]"),
    Rule("access", "AKIA[A-Z0-9]+", holds=lambda m: len(m) >= 20, opening="AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", holds=lambda m: len(m) >= 24, opening="[0-9a-f]{24}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", opening="-----BEGIN "),
    Rule("code_host", "gh[opusr]_[A-Za-z0-9]+", holds=lambda m: len(m) >= 40, opening="gh[opusr]_[A-Za-z0-9]"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9\\-]+", holds=lambda m: len(m) >= 15, opening="xox[abprs]-[A-Za-z0-9\\-]"),
    Rule("signed", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", holds=lambda m: len(m) >= 45, opening="eyJ[A-Za-z0-9_\\-]+\\.eyJ"),
    Rule("login_url", "://[A-Za-z0-9._~\\-]+:[A-Za-z0-9._~!$&*+=\\-]+@", opening="://[A-Za-z0-9._~\\-]+:"),
)


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    whole = compile_rules([(r.opening or r.pattern, r.folded) for r in rules], search=True)
    return whole, [compile_rules([(r.pattern, r.folded)], search=False) for r in rules]


def _fired(automaton: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the automaton accepts (positions) and which rules (bits), in one pass over ``data``."""
    safe = np.isin(data, automaton.resets)
    cuts = np.flatnonzero(safe) + 1
    wanted = np.arange(1, _LANES) * (len(data) // _LANES + 1)
    inner = cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)]
    begins = np.unique(np.concatenate(([0], inner)))
    begins = begins[begins < len(data)]
    lengths = np.diff(np.append(begins, len(data)))
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[longest], lengths[longest]
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    flat = automaton.table.ravel()
    states, positions, masks = np.full(len(begins), automaton.start * 256, np.int64), [], []
    flat256 = flat.astype(np.int64) * 256
    for step in range(int(lengths[0])):
        n = active[step]
        moved = flat256[states[:n] + data[begins[:n] + step]]
        states[:n] = moved
        if moved.max() >= automaton.first * 256:
            hit = np.flatnonzero(moved >= automaton.first * 256)
            positions.append(begins[hit] + step)
            masks.append(automaton.accepts[moved[hit] >> 8])
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(positions), np.concatenate(masks)


def _matches(automaton: _Rows, text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost-longest matches of one rule that do not overlap."""
    table, first, dead, starts = automaton.rows, automaton.first, automaton.dead, automaton.starts
    at, size = 0, len(text)
    while at < size:
        if text[at] not in starts:
            at += 1
            continue
        state, end = automaton.start, -1
        for i in range(at, size):
            state = table[state][text[i]]
            if state == dead:
                break
            if state >= first:
                end = i + 1
        if end > at:
            yield at, end
            at = end
        else:
            at += 1


class _Rows:
    """An automaton with its table as lists, which plain loops read faster."""

    def __init__(self, automaton: Automaton) -> None:
        self.rows, self.first, self.dead, self.start = automaton.table.tolist(), automaton.first, automaton.dead, automaton.start
        self.starts = bytes(np.flatnonzero(automaton.table[automaton.start] != automaton.dead).astype(np.uint8))


@cache
def _as_rows(rules: tuple[Rule, ...]) -> list[_Rows]:
    return [_Rows(a) for a in _compiled(rules)[1]]


def scan(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text, by start, then in the order of ``rules``."""
    whole, _ = _compiled(rules)
    encoded = [x.encode() if x else b"" for x in texts.to_pylist()]
    sizes = np.array([len(x) + 1 for x in encoded])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x + bytes([_BETWEEN]) for x in encoded), np.uint8)
    found: list[list[tuple[str, int, int]]] = [[] for _ in encoded]
    if not len(data):
        return found
    positions, masks = _fired(whole, data)
    which = np.zeros(len(encoded), np.int64)
    np.bitwise_or.at(which, np.searchsorted(ends, positions, side="right"), masks)
    for row in np.flatnonzero(which):
        text, spans = encoded[row], []
        # code points before each byte
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        for rule, (r, automaton) in enumerate(zip(rules, _as_rows(rules), strict=True)):
            if which[row] >> rule & 1:
                spans += [(int(points[a]), rule, int(points[b])) for a, b in _matches(automaton, text) if r.holds(text[a:b])]
        found[row] = [(rules[rule].kind, a, b) for a, rule, b in sorted(spans)]
    return found


def scanned(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: every match of every rule in the whole text."""
    names = [c for c in docs.columns if c != "spans"]
    places = [f"c{i}" for i in range(len(names))]
    frame = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, places, strict=True)])
    schema = T.StructType([*frame.schema.fields, T.StructField("spans", T._parse_datatype_string(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    at = places[names.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in scan(part.column(at), rules)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*part.schema.names, "spans"])

    return frame.mapInArrow(run, schema).toDF(*names, "spans")


def redacted(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans are replaced as one. Texts without secrets stay as they are."""
    frame = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at_text = f"c{docs.columns.index(text)}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at_text):
                column = part.column(at_text).to_pylist()
                for row, spans in enumerate(scan(part.column(at_text))):
                    if spans:
                        old, out, at = column[row], [], 0
                        for _, start, end in sorted(spans, key=lambda s: s[1:]):
                            if start >= at:
                                out += [old[at:start], mark]
                            at = max(at, end)
                        column[row] = "".join(out) + old[at:]
                i = part.schema.get_field_index(at_text)
                yield part.set_column(i, part.schema.field(i), pa.array(column, part.schema.field(i).type))

    return frame.mapInArrow(clean, frame.schema).toDF(*docs.columns)
