"""Boolean trigram queries that every match of a regular expression satisfies.

After R. Cox, "Regular Expression Matching with a Trigram Index" (2012): the
parse tree is walked with sets of exact strings; where a set would grow too
large, or something without fixed text follows, the strings so far become a
query (any of them, each by all its trigrams) that joins the result by AND.
Queries are lower-case, for an index of lower-cased text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops, _parser as parser

_MOST_STRINGS, _MOST_CLASS = 64, 10


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


#: The query that every text satisfies.
EVERYTHING = All(())


def conjunction(*parts):
    flat: list = []
    for p in parts:
        for q in p.parts if isinstance(p, All) else (p,):
            if q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else All(tuple(flat))


def disjunction(*parts):
    if EVERYTHING in parts:
        return EVERYTHING
    flat: list = []
    for p in parts:
        for q in p.parts if isinstance(p, Any) else (p,):
            if q not in flat:
                flat.append(q)
    # A part that asks for more than another part adds nothing.
    terms = [set(q.parts) if isinstance(q, All) else {q} for q in flat]
    flat = [q for q, own in zip(flat, terms, strict=True) if not any(other < own for other in terms)]
    return flat[0] if len(flat) == 1 else Any(tuple(flat))


def _of_strings(strings: set[str]):
    if min(map(len, strings)) < 3:
        return EVERYTHING
    return disjunction(*(conjunction(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _class_members(items) -> set[str] | None:
    members: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            members.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < _MOST_CLASS:
            members |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return members if len(members) <= _MOST_CLASS else None


def _walk(sequence) -> tuple[set[str] | None, object]:
    """The exact strings of a sequence (None: not few), and a query its matches satisfy."""
    current: set[str] = {""}
    query = EVERYTHING
    exact = True
    for op, value in sequence:
        strings, sub, open_end = None, EVERYTHING, False
        if op is ops.LITERAL:
            strings = {chr(value).lower()}
        elif op is ops.IN:
            strings = _class_members(value)
        elif op is ops.SUBPATTERN:
            strings, sub = _walk(value[3])
        elif op is ops.BRANCH:
            found = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            else:
                sub = disjunction(*(_of_strings(s) if s is not None else q for s, q in found))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = value
            inner, inner_query = _walk(body)
            if (least, most) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif least:
                strings, sub, open_end = inner, inner_query if inner is None else EVERYTHING, True
        elif op is ops.AT:
            continue
        if strings is not None and len(current) * len(strings) > _MOST_STRINGS:
            query, current, exact = conjunction(query, _of_strings(current)), {""}, False
        if strings is not None and len(strings) <= _MOST_STRINGS:
            current = {a + b for a in current for b in strings}
        if strings is None or open_end:
            query, current, exact = conjunction(query, _of_strings(current), sub), {""}, False
    if exact:
        return current, EVERYTHING
    return None, conjunction(query, _of_strings(current))


def trigram_query(pattern: str):
    """A query over trigrams (strings, ``All``, ``Any``) implied by a match of ``pattern``."""
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams, query.parts)) if query.parts else set()


def holds(query, present: set[str]) -> bool:
    """Whether a text with these trigrams satisfies the query."""
    if isinstance(query, str):
        return query in present
    return (all if isinstance(query, All) else any)(holds(p, present) for p in query.parts)
