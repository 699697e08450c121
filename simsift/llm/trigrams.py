"""Boolean trigram queries of regular expressions.

``clauses(pattern)`` gives alternatives: every text that holds a match holds all
trigrams of at least one of them, in lower case (A-Z).  An empty alternative means
that the pattern has no mandatory trigrams.

A pattern's parse tree is walked once.  For a part, ``exact`` is the set of all
strings it can match, as long as that is small; otherwise ``before`` and ``after``
hold what any match begins and ends with, and ``needs`` the alternatives known so
far.  Where an exact set grows over MOST strings its trigrams go into ``needs``
and its ends are kept; alternatives over MOST are weakened to none.  Weakening
only ever lets more texts through."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as P

MOST = 32           # strings of a set, alternatives of a query
KEPT = 2            # characters of a known beginning or end

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _simple(found: Clauses) -> Clauses:
    """Without alternatives that another one implies; none left over MOST."""
    least = frozenset(c for c in found if not any(o < c for o in found))
    return least if len(least) <= MOST else ANY


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _simple(frozenset(x | y for x, y in product(a, b))) if len(a) * len(b) <= MOST * MOST else a


def _of(strings: frozenset[str]) -> Clauses:
    return _simple(frozenset(grams(s) for s in strings))


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    before: frozenset[str]
    after: frozenset[str]
    needs: Clauses

    @staticmethod
    def strings(found) -> Part:
        found = frozenset(found)
        if len(found) <= MOST:
            return Part(found, found, found, ANY)
        return Part(None, *_ends(found, found), ANY)

    def needed(self) -> Clauses:
        return _of(self.exact) if self.exact is not None else \
            _both(_both(self.needs, _of(self.before)), _of(self.after))


def _ends(before, after) -> tuple[frozenset[str], frozenset[str]]:
    before, after = frozenset(s[:KEPT] for s in before), frozenset(s[-KEPT:] for s in after)
    none = frozenset([""])
    return (before if len(before) <= MOST else none), (after if len(after) <= MOST else none)


UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANY)
EMPTY = Part.strings([""])


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= MOST else None


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and (both := _joined(a.exact, b.exact)) is not None:
        return Part.strings(both)
    needs = _both(a.needed(), b.needed())
    # Trigrams over the seam.
    seam = _joined(_ends(a.after, a.after)[1], _ends(b.before, b.before)[0])
    if seam is not None:
        needs = _both(needs, _of(seam))
    before = (_joined(a.exact, b.before) or a.exact) if a.exact is not None else a.before
    after = (_joined(a.after, b.exact) or b.exact) if b.exact is not None else b.after
    if a.exact is not None and b.exact is None or a.exact is None and b.exact is not None:
        needs = _both(_both(needs, _of(before)), _of(after))
    return Part(None, *_ends(before, after), needs)


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        return Part.strings(a.exact | b.exact) if len(a.exact | b.exact) <= MOST else \
            Part(None, *_ends(a.exact | b.exact, a.exact | b.exact), _simple(a.needed() | b.needed()))
    return Part(None, *_ends(a.before | b.before, a.after | b.after), _simple(a.needed() | b.needed()))


def _class(items) -> Part:
    """A character class as its folded characters, if few."""
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(fold(chr(value)))
        elif op is C.RANGE and value[1] - value[0] < 4 * MOST:
            found |= {fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    return Part.strings(found) if len(found) <= MOST else UNKNOWN


def _part(tree) -> Part:
    whole = EMPTY
    for op, value in tree:
        if op is C.LITERAL:
            one = Part.strings([fold(chr(value))])
        elif op is C.IN:
            one = _class(value)
        elif op is C.BRANCH:
            one = reduce(_either, [_part(t) for t in value[1]])
        elif op is C.SUBPATTERN:
            one = _part(value[3])
        elif op is C.ATOMIC_GROUP:
            one = _part(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            one = _repeat(*value)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            one = EMPTY
        else:
            one = UNKNOWN
        whole = _then(whole, one)
    return whole


def _repeat(low: int, high, tree) -> Part:
    once = _part(tree)
    if low == 0:
        return _either(EMPTY, once) if high == 1 else UNKNOWN
    copies = reduce(_then, [once] * min(low, 8))
    if high == low <= 8:
        return copies
    return Part(None, *_ends(copies.before, copies.after), copies.needed())


def clauses(pattern: str) -> Clauses:
    """Alternatives of mandatory trigrams; patterns with flags that fold beyond ASCII are
    the caller's to avoid (compile with re.ASCII)."""
    return _part(P.parse(pattern)).needed()
