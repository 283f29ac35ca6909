"""Boolean trigram queries that every text matched by a regular expression must satisfy."""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser as parser

#: Most strings that a part of an expression is expanded to before it is treated as unknown.
MOST_STRINGS = 100

#: A query is a conjunction of clauses; a clause is a set of alternatives; an alternative a set of trigrams, all needed.
Query = list[frozenset[frozenset[str]]]


def _clause(strings: set[str]) -> Query:
    """What a text that holds one of ``strings`` must hold."""
    alternatives = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in alternatives:
        return []
    return [frozenset(a for a in alternatives if not any(b < a for b in alternatives))]


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that ``nodes`` can match, or None if unknown; clauses for what is unknown)."""
    done: Query = []
    strings: set[str] = {""}
    whole = True
    for op, arg in nodes:
        known, clauses = _node(op, arg)
        done += clauses
        if known is not None and len(known) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, known)}
            continue
        whole = False
        done += _clause(strings)
        # What is known of the element stands at the start of what follows, so its strings can go on.
        strings = known if known is not None and len(known) <= MOST_STRINGS else {""}
    if whole:
        return strings, done
    return None, done + _clause(strings)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, []
    if op is sre.IN:
        if all(kind is sre.LITERAL for kind, _ in arg):
            return {chr(c).lower() for _, c in arg}, []
        return None, []
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(branch) for branch in arg[1]]
        if all(known is not None and not clauses for known, clauses in parts):
            return set().union(*(known for known, _ in parts)), []
        return None, []
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        known, clauses = _walk(inner)
        if known is not None and not clauses and most != sre.MAXREPEAT and most <= 4 and len(known) ** most <= MOST_STRINGS:
            return {"".join(p) for n in range(least, most + 1) for p in product(known, repeat=n)}, []
        if least == 0:
            return None, []
        return None, clauses + (_clause(known) if known is not None else [])
    if op is sre.AT:
        return {""}, []
    return None, []


def trigram_query(pattern: str) -> Query:
    """Clauses over lower-case trigrams; an empty list where the expression has none that is mandatory."""
    known, clauses = _walk(parser.parse(pattern))
    return list(dict.fromkeys(clauses + (_clause(known) if known is not None else [])))


def trigrams(query: Query) -> set[str]:
    return {t for clause in query for alternative in clause for t in alternative}
