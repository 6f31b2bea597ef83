"""Boolean trigram queries derived from regular expressions.

A pattern's parse tree is walked from left to right. As long as the strings that a part can match are few,
they are kept; where they aren't known any more (a wide class, an open repeat), those so far are turned into
trigrams, and the walk starts anew behind. A branch asks for any of its arms' trigrams, a sequence for all of its
parts', a part that may be absent for none. Strings are the bytes of UTF-8, A-Z lower-cased, one character for
each byte, as the index sees them. Whatever the walk doesn't know, it asks nothing of: the query may find texts
without a match, but never misses one with a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

#: A query: any of these sets, with all of a set's trigrams. ANY asks for nothing; () can't be met.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])

MOST_STRINGS, MOST_CLASS, MOST_SETS = 64, 8, 64


@dataclass(frozen=True)
class Part:
    """strings: all that the part can match, or None; query: what any match of it holds."""

    strings: frozenset[str] | None
    query: Query = ANY


NOTHING, UNKNOWN = Part(frozenset([""])), Part(None)


def simplest(query: Query) -> Query:
    """Without the sets that hold another one."""
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    """All that either asks for, or the more selective of the two where that would be too many sets."""
    if len(a) * len(b) > MOST_SETS:
        return max(a, b, key=lambda q: min(map(len, q), default=0))
    return simplest(frozenset(x | y for x in a for y in b))


def either(a: Query, b: Query) -> Query:
    out = simplest(a | b)
    return out if len(out) <= MOST_SETS else ANY


def of_strings(strings: frozenset[str]) -> Query:
    return simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _asked(part: Part) -> Query:
    return part.query if part.strings is None else of_strings(part.strings)


def _spelled(code: int) -> str:
    """A character as the index sees it."""
    return chr(code).encode(errors="surrogatepass").lower().decode("latin-1")


def _class(items, flags: int) -> Part:
    """A class of few characters. One that is open (negated, or with a category) isn't known."""
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 4 * MOST_CLASS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    if not all(_plain(c, flags) for c in codes):
        return UNKNOWN
    spelled = frozenset(map(_spelled, codes))
    return Part(spelled) if len(spelled) <= MOST_CLASS else UNKNOWN


def _plain(code: int, flags: int) -> bool:
    """Whether other characters than the other case of A-Z can't match it."""
    return not flags & re.IGNORECASE or bool(flags & re.ASCII) or not chr(code).isalpha()


def _sequence(parts) -> Part:
    """Parts one after the other."""
    strings, query, known = frozenset([""]), ANY, True
    for part in parts:
        if part.strings is not None and len(strings) * len(part.strings) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in part.strings)
            continue
        known, query = False, both(query, of_strings(strings))
        query, strings = (both(query, part.query), frozenset([""])) if part.strings is None else (query, part.strings)
    return Part(strings) if known else Part(None, both(query, of_strings(strings)))


def _branch(arms: list[Part]) -> Part:
    if all(a.strings is not None for a in arms) and len(strings := frozenset().union(*(a.strings for a in arms))) <= MOST_STRINGS:
        return Part(strings)
    query = _asked(arms[0])
    for arm in arms[1:]:
        query = either(query, _asked(arm))
    return Part(None, query)


def _repeat(least: int, most: int, part: Part) -> Part:
    """The part from `least` to `most` times: spelled out if that is little, else what stands at the beginning."""
    if most <= 3:
        return _branch([_sequence([part] * n) for n in range(least, most + 1)])
    if not least:
        return UNKNOWN
    begins = _sequence([part] * min(least, 3))
    return begins if least == most and least <= 3 else Part(None, _asked(begins))


def _node(kind, value, flags: int) -> Part:
    if kind is op.LITERAL:
        return Part(frozenset([_spelled(value)])) if _plain(value, flags) else UNKNOWN
    if kind is op.IN:
        return _class(value, flags)
    if kind is op.SUBPATTERN:
        _, add, without, inside = value
        return _walk(inside, (flags | add) & ~without)
    if kind is op.ATOMIC_GROUP:
        return _walk(value, flags)
    if kind is op.BRANCH:
        return _branch([_walk(arm, flags) for arm in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inside = value
        return _repeat(least, int(most), _walk(inside, flags))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return NOTHING  # of no width; what it asks for is left to the pattern
    return UNKNOWN


#: Runs of this length or more are worth looking for.
LEAST_RUN = 8


def run_of(pattern: str, flags: int = 0) -> tuple[int, frozenset[int]] | None:
    """(n, characters): every match holds a run of n or more of these ASCII characters. None if the pattern shows no such run."""
    tree = _parser.parse(pattern, flags)
    found = None
    for kind, value in tree:
        if kind not in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) or len(value[2]) != 1 or tree.state.flags & re.IGNORECASE:
            continue
        inner, items = value[2][0]
        items = items if inner is op.IN else [(inner, items)]
        codes: set[int] | None = set()
        for what, code in items:
            if what is op.LITERAL and code < 128:
                codes.add(code)
            elif what is op.RANGE and code[1] < 128:
                codes.update(range(code[0], code[1] + 1))
            else:
                codes = None
                break
        if codes and value[0] >= LEAST_RUN and (found is None or value[0] > found[0]):
            found = int(value[0]), frozenset(codes)
    return found


def _walk(tree, flags: int) -> Part:
    return _sequence(_node(kind, value, flags) for kind, value in tree)


def query_of(pattern: str, flags: int = 0) -> Query:
    """The query that every text with a match of the pattern meets; empty if the pattern has no mandatory trigram."""
    tree = _parser.parse(pattern, flags)
    query = _asked(_walk(tree, tree.state.flags))
    return frozenset() if frozenset() in query else query
