"""Query text and query objects, one from the other.

    20:1,234-5,678 AND info:DP < 50 AND sample_name = TUMOR ORDER BY sample:GQ DESC, contig

A small reader of one line: terms joined by AND, then an optional ORDER BY.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from varloom.plans.query import Filter, Query, Range, Sort

_FIELD = r"[0-9A-Za-z.:_-]+"
_COMPARE = re.compile(rf"""(?P<f>{_FIELD})\s*(?P<op><=|<|>=|>|=|!=|(?i:R?LIKE))\s*(?:(?P<v>[0-9A-Za-z.]+)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)')""")
_NULL = re.compile(rf"(?P<f>{_FIELD})\s+IS\s+(?P<n>NOT\s+)?NULL", re.I)
_RANGE = re.compile(r"(?P<c>(?:[cC][hH][rR])?[0-9]+|X|Y):(?P<r>(?P<s>[0-9,]+)?-(?P<e>[0-9,]+)?)?")
_ORDER = re.compile(rf"ORDER BY\s+(?P<l>{_FIELD}(?:\s+(?:ASC|DESC))?(?:\s*,\s*{_FIELD}(?:\s+(?:ASC|DESC))?)*)", re.I)
_PLAIN = re.compile(r"[0-9A-Za-z.]+")


class QueryError(ValueError):
    """Text that is no query; the message is `SyntaxError`, or names the first unknown field."""


def _term(text: str, at: int):
    # a filter is tried before a range, as a range may look like a field
    for kind in (_COMPARE, _NULL, _RANGE):
        if m := kind.match(text, at):
            return kind, m
    raise QueryError("SyntaxError")


def parse(text: str, columns: Iterable[str]) -> Query:
    known = set(columns)
    filters, ranges, sort, names = [], [], [], []
    text = text.strip()
    at = 0
    while at < len(text) and not _ORDER.match(text, at):
        kind, m = _term(text, at)
        if kind is _RANGE:
            number = lambda x: int(digits) if x and (digits := x.replace(",", "")) else None
            ranges.append(Range(m["c"], number(m["s"]) or None, number(m["e"]) or None))
        else:
            names.append(m["f"])
            if kind is _NULL:
                filters.append(Filter(m["f"], "NOT NULL" if m["n"] else "NULL"))
            else:
                filters.append(Filter(m["f"], m["op"].upper(), next(m[g] for g in ("v", "dq", "sq") if m[g] is not None)))
        at = m.end()
        if at < len(text):
            if joint := re.compile(r"\s+AND\s+", re.I).match(text, at):
                at = joint.end()
                if at == len(text) or _ORDER.match(text, at):
                    raise QueryError("SyntaxError")
            else:
                at += len(text[at:]) - len(text[at:].lstrip())
                if not _ORDER.match(text, at):
                    raise QueryError("SyntaxError")
    if at < len(text):
        m = _ORDER.match(text, at)
        if m.end() != len(text):
            raise QueryError("SyntaxError")
        for part in re.split(r"\s*,\s*", m["l"]):
            name, *order = part.split()
            names.append(name)
            sort.append(Sort(name, bool(order) and order[0].upper() == "DESC"))
    if len(ranges) > 1:
        raise QueryError("Only one range is allowed")
    for name in names:
        if name not in known:
            raise QueryError(f"Unknown field {name}")
    return Query(tuple(filters), ranges[0] if ranges else Range(), tuple(sort))


def quoted(value: object) -> str:
    text = str(value)
    if _PLAIN.fullmatch(text):
        return text
    for mark in "'\"":
        if mark not in text:
            return f"{mark}{text}{mark}"
    raise QueryError("a value with both kinds of quotes cannot be written")


def to_text(query: Query) -> str:
    terms = []
    r = query.range
    if r.contig is not None:
        bounds = "" if r.start is None and r.end is None else f"{r.start or ''}-{r.end or ''}"
        terms.append(f"{r.contig}:{bounds}")
    for f in query.filters:
        terms.append(f"{f.column} IS {f.op}" if f.op in ("NULL", "NOT NULL") else f"{f.column} {f.op} {quoted(f.value)}")
    order = ", ".join(s.column + " DESC" * s.descending for s in query.sort)
    return " ".join([x for x in (" AND ".join(terms), f"ORDER BY {order}" if order else "") if x])


def equivalent(a: Query, b: Query) -> bool:
    """Whether two queries mean the same: filters in any order, sort columns in order."""
    return Counter(a.filters) == Counter(b.filters) and a.range == b.range and a.sort == b.sort
