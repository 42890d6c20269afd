"""Which of many patterns can match a line, found in one pass.

From each pattern's own syntax a set of literals is derived of which every match must hold at least one. All literals go
into one automaton, so a pattern is tried only on lines that hold one of its literals. Patterns from which no literal
follows are tried on every line: nothing is lost, whatever the patterns are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from re import _constants as C
from re import _parser

import ahocorasick

#: Alternatives that are multiplied out at most when neighbouring parts of a pattern are put together.
MOST = 256


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer, the smaller one of equals."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if rank(a) >= rank(b) else b


def _usable(s: set[str] | None) -> set[str] | None:
    return s if s and all(s) else None


def _charset(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 12:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _sequence(nodes) -> tuple[set[str] | None, set[str] | None]:
    """(all texts that the nodes match, or None; literals of which each match holds one, or None)."""
    run: set[str] = {""}
    best: set[str] | None = None
    whole = True
    for op, arg in nodes:
        texts, needed = _node(op, arg)
        if texts is not None and len(run) * len(texts) <= MOST:
            run = {a + b for a in run for b in texts}
            continue
        whole = False
        best = _better(best, _usable(run))
        best = _better(best, needed)
        run = texts if texts is not None else {""}
    best = _better(best, _usable(run))
    return (run if whole else None), best


def _node(op, arg) -> tuple[set[str] | None, set[str] | None]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, None
    if op is C.IN:
        return _charset(arg), None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(t is not None for t, _ in parts):
            return set().union(*(t for t, _ in parts)), None
        needed = [_better(_usable(t), n) for t, n in parts]
        return None, set().union(*needed) if all(needed) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        texts, needed = _sequence(body)
        if texts is not None and most == 1:
            return texts | {""} if least == 0 else texts, None
        return None, _better(_usable(texts), needed) if least else None
    return None, None


def literals(pattern: str) -> set[str] | None:
    """Lower-case literals of which every match of ``pattern``, lowered, holds one; None if none can be derived."""
    texts, needed = _sequence(_parser.parse(pattern))
    return _better(_usable(texts), needed)


class Sieve:
    """Named patterns behind one automaton."""

    def __init__(self, patterns: list[tuple[str, str, int]]):
        """``patterns`` is (name, pattern, flags)."""
        self.names = [n for n, _, _ in patterns]
        self.compiled = [re.compile(p, f) for _, p, f in patterns]
        self.always: list[int] = []
        held: dict[str, set[int]] = {}
        for k, (_, p, _) in enumerate(patterns):
            found = literals(p)
            if not found:
                self.always.append(k)
            for literal in found or ():
                held.setdefault(literal, set()).add(k)
        self.machine = ahocorasick.Automaton()
        for literal, of in held.items():
            self.machine.add_word(literal, frozenset(of))
        if held:
            self.machine.make_automaton()

    def tried(self, lowered: list[str]) -> dict[int, set[int]]:
        """Line -> the patterns that can match it; ``lowered`` are the lines in lower case."""
        out: dict[int, set[int]] = {k: set(self.always) for k in range(len(lowered))} if self.always else {}
        if len(self.machine):
            starts, at = [], 0
            for line in lowered:
                starts.append(at)
                at += len(line) + 1
            # a sign that ends no line stands between lines; a literal never holds one
            for end, of in self.machine.iter("\x00".join(lowered).replace("ſ", "s")):
                out.setdefault(bisect_right(starts, end) - 1, set()).update(of)
        return out

    def names_of(self, line: str, tried: set[int]) -> set[str]:
        """The names of the patterns among ``tried`` that match ``line``."""
        found: set[str] = set()
        for k in tried:
            if self.names[k] not in found and self.compiled[k].search(line):
                found.add(self.names[k])
        return found
