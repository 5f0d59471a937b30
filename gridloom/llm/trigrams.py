"""Boolean trigram queries from regular expressions."""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as K
    import sre_parse as parser

#: More strings than this are no longer spelled out.
EXACT = 24

#: A query is a list of clauses that all hold; a clause is a set of alternatives; an
#: alternative is a set of trigrams that all occur. No clauses: every text may match.
Query = list[frozenset[frozenset[str]]]


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> Query:
    """What any text holding one of the strings must have."""
    alternatives = {_grams(s) for s in strings}
    if frozenset() in alternatives:
        return []
    return [frozenset(a for a in alternatives if not any(b < a for b in alternatives))]


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, x in items:
        if op is K.LITERAL:
            out.add(chr(x).lower())
        elif op is K.RANGE and x[1] - x[0] < EXACT:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(node) -> tuple[set[str] | None, Query]:
    """(all strings that the node can match, if few; what its match must have besides)."""
    op, x = node
    if op is K.LITERAL:
        return {chr(x).lower()}, []
    if op is K.IN:
        return _class(x), []
    if op is K.SUBPATTERN:
        return _sequence(x[-1])
    if op is K.BRANCH:
        parts = [_sequence(p) for p in x[1]]
        if all(e is not None and not q for e, q in parts):
            union = set().union(*[e for e, _ in parts])
            return (union, []) if len(union) <= EXACT else (None, _clause(union))
        return None, []
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, body = x
        exact, query = _sequence(body)
        if exact is not None and not query and high != K.MAXREPEAT and high <= 3:
            strings = {"".join(p) for n in range(low, high + 1) for p in product(exact, repeat=n)}
            if len(strings) <= EXACT:
                return strings, []
        return None, (query + (_clause(exact) if exact else [])) if low else []
    if op is K.AT:
        return {""}, []
    return None, []


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    whole, query = True, []
    for node in nodes:
        exact, more = _walk(node)
        query += more
        if exact is not None and len(run) * len(exact) <= EXACT:
            run = {a + b for a in run for b in exact}
            continue
        query += _clause(run)
        whole = False
        run = exact if exact is not None else {""}
    if whole:
        return run, query
    return None, query + _clause(run)


def query(pattern: str) -> Query:
    """Trigrams that every text with a match has, after lowering letters."""
    exact, out = _sequence(parser.parse(pattern, re.IGNORECASE if pattern.startswith("(?i)") else 0))
    return out + (_clause(exact) if exact is not None else [])
