"""Literals that any match of a pattern must hold, so that a pattern is run only on texts that have one of them.

The literals are derived from the parsed pattern, so a text without them can't match: the filter is exact.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: Most strings that a set may hold.
FEW = 256
#: Letters that some letters match when case is ignored, beyond what lower() folds; and all white space is one sign.
_FOLD = [("ſ", "s"), ("ı", "i"), ("ς", "σ"), *((chr(c), " ") for c in range(0x3001) if c != 32 and chr(c).isspace())]


def fold(text: str) -> str:
    """The form of a text that literals are looked up in, as long as its lower-cased form."""
    text = text.lower()
    for a, b in _FOLD:
        text = text.replace(a, b)
    return text


def _rarity(literal: str) -> float:
    """How seldom a literal is in texts, roughly: letters and digits count one, other signs four, spaces nothing."""
    return sum(1 if c.isalnum() else 0 if c.isspace() else 4 for c in literal)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets of which one member each must occur, the one whose commonest member is rarer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(_rarity, s)), -len(s)))


def _members(items) -> set[str] | None:
    """The characters of a small class."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 10:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif kind is op.CATEGORY and value is op.CATEGORY_SPACE:
            out.add(" ")
        else:
            return None
    return out if len(out) <= 10 else None


def _needs(tree) -> set[str] | None:
    """Strings of which each match has one at least; None if there is no such set."""
    best, runs = None, {""}
    for kind, value in [*tree, (op.ANY, None)]:
        exact = _exact(kind, value)
        if exact is not None and len(exact) * len(runs) <= FEW:
            runs = {r + e for r in runs for e in exact}
            continue
        if all(map(str.strip, runs)):
            best = _better(best, runs)
        runs = {""}
        if kind is op.BRANCH:
            each = [_needs(t) for t in value[1]]
            best = _better(best, set().union(*each) if all(each) else None)
        elif kind is op.SUBPATTERN:
            best = _better(best, _needs(value[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            inner = _sequence(value[2])
            best = _better(best, {x * value[0] for x in inner} if inner is not None and len(inner) == 1 else _needs(value[2]))
        elif exact is not None:
            runs = exact
    return best


def _exact(kind, value) -> set[str] | None:
    """All strings that a part of a pattern can match, if they are few."""
    if kind is op.LITERAL:
        return {chr(value)}
    if kind is op.IN:
        return _members(value)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        each = [_sequence(t) for t in value[1]]
        return set().union(*each) if all(x is not None for x in each) and sum(map(len, each)) <= FEW else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[:2] == (0, 1):
        inner = _sequence(value[2])
        return inner | {""} if inner is not None and len(inner) < FEW else None
    return None


def _sequence(tree) -> set[str] | None:
    out = {""}
    for kind, value in tree:
        exact = _exact(kind, value)
        if exact is None or len(exact) * len(out) > 64:
            return None
        out = {o + e for o in out for e in exact}
    return out


def literals(pattern: str, flags: int = 0) -> set[str]:
    """Folded strings of which any match of the pattern has one; fails if there are none."""
    found = _needs(parser.parse(pattern, flags))
    if not found:
        raise ValueError(f"no literal: {pattern}")
    return {fold(x) for x in found}


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a verbose pattern."""
    out, depth, at, begin, inside = [], 0, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]" or at == opened + 1
        elif c == "[":
            inside, opened = True, at + 1 if pattern[at + 1] == "^" else at
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return [p for p in (*out, pattern[begin:]) if p.strip()]


class Rules:
    """Patterns of several kinds behind one automaton of their literals."""

    def __init__(self, patterns: dict[str, tuple[str, int]], words: dict[str, set[str]] | None = None):
        import ahocorasick

        self.rules: list[tuple[str, re.Pattern | None]] = []
        by: dict[str, set[int]] = {}
        for kind, (whole, flags) in patterns.items():
            for part in alternatives(whole):
                for x in literals(part, flags):
                    by.setdefault(x, set()).add(len(self.rules))
                self.rules.append((kind, re.compile(part, flags)))
        for kind, own in (words or {}).items():
            for w in own:
                by.setdefault(fold(w), set()).add(len(self.rules))
            self.rules.append((kind, None))
        self.automaton = ahocorasick.Automaton()
        for x, rules in by.items():
            self.automaton.add_word(x, tuple(rules))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, tuple[int, ...]]]:
        """(last place, rules) of each literal in a folded text."""
        return list(self.automaton.iter(folded))
