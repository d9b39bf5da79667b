"""A query on a run's calls: filters, one range, sort columns, a page and a truth run."""
from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

PAGE_ROWS = 250
#: Filters that also hold for the truth run of a comparison.
TRUTH_COLUMNS = ("reference", "alternates", "sample_name")


class UnknownColumn(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Range:
    contig: str | None = None
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    range: Range = Range()
    sort: tuple[Sort, ...] = ()
    page: int = 0
    limit: int | None = None
    truth: int | None = None
    types: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def from_json(data: Mapping) -> Query:
        """The query object that clients send: filters, range, sortBy, page, limit, compareToVcfId."""
        if data.get("limit") and data.get("page") is None:
            raise ValueError("a limit needs a page")
        r = data.get("range") or {}
        number = lambda x: int(str(x).replace(",", "")) if x not in (None, "") else None
        return Query(
            tuple(Filter(f["columnName"], f["type"], f.get("filterValue")) for f in data.get("filters") or []),
            Range(r.get("contig"), number(r.get("start")), number(r.get("end"))),
            tuple(Sort(s["columnName"], str(s.get("order", "asc")).lower() == "desc") for s in data.get("sortBy") or []),
            int(data.get("page") or 0),
            int(data["limit"]) if data.get("limit") else None,
            data.get("compareToVcfId"),
        )

    def to_json(self) -> dict:
        """The query object that clients send; the inverse of `from_json`, without types."""
        out = {
            "filters": [{"columnName": f.column, "type": f.op, "filterValue": f.value} for f in self.filters],
            "range": {"contig": self.range.contig, "start": self.range.start, "end": self.range.end},
            "sortBy": [{"columnName": s.column, "order": "desc" if s.descending else "asc"} for s in self.sort],
            "page": self.page, "limit": self.limit, "compareToVcfId": self.truth,
        }
        return out

    def type_of(self, column: str) -> str:
        return self.types.get(column, "integer" if column == "position" else "string")

    def typed(self, types: Mapping[str, str], columns: Iterable[str]) -> Query:
        """With the types of a run's header; columns that the table lacks are refused before anything is planned."""
        known = set(columns)
        for name in [f.column for f in self.filters] + [s.column for s in self.sort]:
            if name not in known:
                raise UnknownColumn(f"Unknown field {name}")
        return Query(self.filters, self.range, self.sort, self.page, self.limit, self.truth, {k: v.lower() for k, v in types.items()})

    def truth_filters(self) -> tuple[Filter, ...]:
        return tuple(f for f in self.filters if f.column in TRUTH_COLUMNS)

    def with_defaults(self) -> Query:
        """As clients complete it: sorted by contig and position, and a sort that begins with position means both."""
        sort = self.sort or (Sort("position"),)
        if sort[0].column == "position":
            sort = (Sort("contig", sort[0].descending), Sort("position", sort[0].descending))
        return Query(self.filters, self.range, sort, self.page, self.limit or PAGE_ROWS, self.truth, self.types)
