"""Regular expressions over bytes compiled to one minimal deterministic automaton with flat transition arrays.

The syntax is that of plain regular languages: literals, ``[...]`` classes, ``.``, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``,
``{m,n}``. There are no anchors, captures or look-around. States are numbered so that the accepting ones come last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ANY = (1 << 256) - 1
_ESCAPES = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \t\n\x0b\x0c\r"}


def _bits(spec: str) -> int:
    """The set of bytes that the inside of a class names, as bits."""
    negate, out, i = spec.startswith("^"), 0, 0
    spec = spec[negate:]
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            out |= sum(1 << b for b in range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out |= 1 << ord(spec[i])
            i += 1
    return _ANY & ~out if negate else out


class _Parser:
    """Builds a nondeterministic automaton: ``edges`` by byte set, ``empty`` moves without a byte."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def compile(self, pattern: str, folded: bool) -> tuple[int, int]:
        self.text, self.at, self.folded = pattern, 0, folded
        tree = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return self._build(tree)

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return ("either", options) if len(options) > 1 else options[0]

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("sequence", parts)

    def _repeated(self):
        part = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.text.index("}", self.at)
                a, comma, b = self.text[self.at : end].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.at = end + 1
            part = ("repeat", part, low, high)
        return part

    def _atom(self):
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            inner = self._either()
            self.at += 1
            return inner
        if c == "[":
            end, spec = self.at, ""
            while self.text[end] != "]":
                if self.text[end] == "\\":
                    end += 1
                spec += _ESCAPES.get(self.text[end], self.text[end]) if self.text[end - 1] == "\\" else self.text[end]
                end += 1
            self.at = end + 1
            return ("bytes", self._cased(_bits(spec)))
        if c == ".":
            return ("bytes", _ANY & ~(1 << 10))
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c in _ESCAPES:
                return ("bytes", _bits(_ESCAPES[c]))
            if c == "x":
                c = chr(int(self.text[self.at : self.at + 2], 16))
                self.at += 2
        return ("bytes", self._cased(1 << ord(c)))

    def _cased(self, bits: int) -> int:
        if self.folded:
            for low, high in zip(range(97, 123), range(65, 91), strict=True):
                if bits >> low & 1 or bits >> high & 1:
                    bits |= 1 << low | 1 << high
        return bits

    def _build(self, tree) -> tuple[int, int]:
        start, end = self.state(), self.state()
        match tree:
            case ("bytes", bits):
                self.edges[start].append((bits, end))
            case ("either", options):
                for option in options:
                    a, b = self._build(option)
                    self.empty[start].append(a)
                    self.empty[b].append(end)
            case ("sequence", parts):
                at = start
                for part in parts:
                    a, b = self._build(part)
                    self.empty[at].append(a)
                    at = b
                self.empty[at].append(end)
            case ("repeat", part, low, high):
                at = start
                for _ in range(low):
                    a, b = self._build(part)
                    self.empty[at].append(a)
                    at = b
                if high is None:
                    a, b = self._build(part)
                    self.empty[at].append(a)
                    self.empty[b].append(a)
                    self.empty[b].append(end)
                for _ in range((high or low) - low):
                    a, b = self._build(part)
                    self.empty[at].extend((a, end))
                    at = b
                self.empty[at].append(end)
        return start, end


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state; ``accepts[state]`` has bit r for rule r; states from ``first`` on accept."""

    table: np.ndarray
    accepts: np.ndarray
    start: int
    first: int
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """Bytes after which the automaton is in its start state, whatever came before."""
        return np.flatnonzero((self.table == self.start).all(axis=0))


def compile_rules(patterns: list[tuple[str, bool]], search: bool) -> Automaton:
    """One automaton for all (pattern, either case). ``search``: a match may begin at any byte; else at the first only."""
    nfa = _Parser()
    ends: dict[int, int] = {}
    roots = []
    for rule, (pattern, folded) in enumerate(patterns):
        start, end = nfa.compile(pattern, folded)
        ends[end] = 1 << rule
        roots.append(start)

    def closure(states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in nfa.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(s for s in seen if nfa.edges[s] or s in ends)

    # bytes that no pattern tells apart share a column
    distinct = {bits for edges in nfa.edges for bits, _ in edges}
    signature: dict[tuple, int] = {}
    columns = np.array([signature.setdefault(tuple(bits >> b & 1 for bits in distinct), len(signature)) for b in range(256)])
    samples = [int(np.flatnonzero(columns == c)[0]) for c in range(len(signature))]

    origin = closure(roots)
    numbered, rows, order = {origin: 0}, [], [origin]
    for subset in order:
        row = []
        for byte in samples:
            reached = {t for s in subset for bits, t in nfa.edges[s] if bits >> byte & 1}
            target = closure(reached | set(roots)) if search else closure(reached)
            if target not in numbered:
                numbered[target] = len(order)
                order.append(target)
            row.append(numbered[target])
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum(ends.get(s, 0) for s in subset) for subset in order], np.int64)

    # minimisation: split the classes until no byte tells two states of one class apart
    classes = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([classes, classes[moves]]), axis=0, return_inverse=True)
        if finer.max() == classes.max():
            break
        classes = finer
    classes = finer.ravel()
    _, member = np.unique(classes, return_index=True)
    ordered = member[np.argsort(accepts[member] != 0, kind="stable")]
    renumber = np.empty(len(ordered), np.int64)
    renumber[classes[ordered]] = np.arange(len(ordered))
    small = renumber[classes[moves[ordered]]]
    first = int((accepts[ordered] == 0).sum())
    dead = next((s for s in range(first) if (small[s] == s).all()), -1)
    return Automaton(small[:, columns].astype(np.int32), accepts[ordered], int(renumber[classes[0]]), first, dead)
