"""VCF files as a data source: spark.read.format("vcf").load(path).where("contig = '20' and position < 5000").

    register(spark)

The schema comes from the file's header: the parts that every call has, and the declared fields that the call table keeps.
Long files are divided among tasks by bytes, each of which begins at its first whole line.  Filters on contig and position
are pushed into the source, which looks at the first two cells of a line before it reads the others.

`varloom.sources.vcf.read_vcf` reads the same rows with Spark's own expressions; this source is for SQL and for readers
that know no header.  Options: path (a file, or a folder of files of one header), vcf_id, split_bytes.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from varloom.schema import CALLS, CORE
from varloom.sources import header as H
from varloom.sources.paths import files_of, system_of

SPLIT_BYTES, BATCH = 64 << 20, 5_000
_READ = 1 << 20


def header_of(path: str) -> list[str]:
    """Header lines of a file, or of the first file of a folder that has a line of samples."""
    system, _ = system_of(path)
    for name, _ in files_of(path):
        lines = []
        for line in _lines(system, name, 0, None):
            if not line.startswith("#"):
                break
            lines.append(line)
            if line.startswith("#CHROM"):
                return lines
            if len(lines) > H.MAX_LINES:
                raise ValueError(f"{path} has more than {H.MAX_LINES} header lines")
    raise ValueError(f"{path} has no #CHROM line")


def _lines(system, path: str, low: int, high: int | None) -> Iterator[str]:
    """Lines that begin in a file's bytes from `low` to before `high`."""
    with system.open_input_file(path) as f:
        at, rest = max(0, low - 1), b""
        f.seek(at)
        skip = low > 0  # what is left of a line that began before; nothing if the byte before ends one
        while True:
            data = f.read(_READ)
            if not data:
                if rest and not skip:
                    yield rest.decode()
                return
            rest += data
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if not skip:
                    yield line.removesuffix(b"\r").decode()
                skip = False
                at += len(line) + 1
                if high is not None and at >= high:
                    return


@dataclass
class _Part(InputPartition):
    path: str
    low: int
    high: int | None


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> StructType:
        there = {*CORE, *[f.column for f in H.fields(header_of(self.options["path"])) if H.known(f)]}
        return StructType([f for f in CALLS.fields if f.name in there])

    def reader(self, schema: StructType) -> VcfReader:
        return VcfReader(self.options["path"], schema, int(self.options.get("vcf_id", 0)), int(self.options.get("split_bytes", SPLIT_BYTES)))


@dataclass
class VcfReader(DataSourceReader):
    path: str
    schema: StructType
    vcf_id: int = 0
    split_bytes: int = SPLIT_BYTES
    contigs: set[str] | None = None
    low: int = 0
    high: int = 1 << 62
    pushed: list[str] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Contigs by name and bounds of positions hold for all rows that come back; other filters stay with Spark."""
        of_position = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        bounded = any(isinstance(f, of_position) and f.attribute == ("position",) for f in filters)
        for f in filters:
            if isinstance(f, IsNotNull) and (f.attribute == ("contig",) or bounded and f.attribute == ("position",)):
                continue  # a record has a contig, and one that has no position does not lie within bounds
            if isinstance(f, (EqualTo, In)) and f.attribute == ("contig",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = names if self.contigs is None else self.contigs & names
            elif isinstance(f, EqualTo) and f.attribute == ("position",):
                self.low, self.high = max(self.low, int(f.value)), min(self.high, int(f.value) + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("position",):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("position",):
                self.high = min(self.high, int(f.value) + isinstance(f, LessThanOrEqual))
            else:
                yield f
                continue
            self.pushed.append(str(f))

    def partitions(self) -> list[_Part]:
        out = []
        for path, size in files_of(self.path):
            cuts = [*range(0, max(size, 1), self.split_bytes)]
            out += [_Part(path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def wanted(self, line: str) -> bool:
        """Whether the record can pass, by its first two cells."""
        if not line.strip() or line[0] == "#":
            return False
        if self.contigs is None and not self.low and self.high == 1 << 62:
            return True
        contig, _, rest = line.partition("\t")
        if self.contigs is not None and contig not in self.contigs:
            return False
        place = rest.partition("\t")[0].strip()
        if not self.low and self.high == 1 << 62:
            return True
        return bool(re.fullmatch(r"[+-]?\d+", place)) and self.low <= int(place) < self.high

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        header, target = header_of(self.path), to_arrow_schema(self.schema)
        parse, rows = parser(header, [f.name for f in self.schema.fields], self.vcf_id), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

        system, _ = system_of(self.path)
        for line in _lines(system, partition.path, partition.low, partition.high):
            if self.wanted(line):
                rows += parse(line)
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


def _value(text: str | None) -> str | None:
    return text if text not in (None, "", ".") else None


def _listed(text: str | None, f: H.Field) -> str | None:
    if text is None or not f.is_list:
        return text
    mark = "'" if f.type.lower() in ("string", "character") else ""
    return "[" + ", ".join(f"{mark}{x}{mark}" for x in text.split(",")) + "]"


def parser(header: list[str], columns: list[str], vcf_id: int) -> Callable[[str], list[tuple]]:
    """From a record line to its calls, one for each sample."""
    names = H.samples(header)
    declared = {f.column: f for f in H.fields(header) if H.known(f)}

    def parse(line: str) -> list[tuple]:
        p = line.split("\t")
        cell = lambda i: p[i] if i < len(p) else None
        place, filters = (cell(1) or "").strip(), cell(6)
        info = dict((k, v if eq else None) for k, eq, v in (x.partition("=") for x in (cell(7) or "").split(";")))
        keys = (cell(8) or "").split(":")
        position = int(place) if re.fullmatch(r"[+-]?\d+", place) and -(2**31) <= int(place) < 2**31 else None
        own = {
            "vcf_id": vcf_id, "contig": cell(0), "position": position, "id": _value(cell(2)), "reference": cell(3), "alternates": _value(cell(4)),
            "quality": _value(cell(5)), "filters": (_value(filters) or "").replace(";", ",") or None if filters != "PASS" else None,
        }
        for column, f in declared.items():
            if f.group == "INFO":
                own[column] = ("True" if f.name in info else None) if f.type.lower() == "flag" else _listed(_value(info.get(f.name)), f)
        out = []
        for i, name in enumerate(names):
            cells = text.split(":") if (text := cell(H.FIXED + i)) is not None else []
            of = {c: _listed(_value(cells[k]) if (k := keys.index(f.name)) < len(cells) else None, f) for c, f in declared.items() if f.group == "FORMAT" and f.name in keys}
            row = {**own, **of, "sample_name": name}
            out.append(tuple(row.get(c) for c in columns))
        return out

    return parse


def register(spark: SparkSession) -> None:
    """Makes format("vcf") known to the session, and lets Spark push filters into such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfSource)
