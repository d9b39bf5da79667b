"""Header lines of VCF text: samples, field declarations, and the column spec that follows from them."""
from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession

from varloom.schema import ANNOTATIONS, INFO, SAMPLE

_DECLARED = re.compile(r'##(INFO|FORMAT)=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)(?:,Description="(.*?)")?.*>')
#: Header lines that are read; a longer header is refused.
MAX_LINES = 100_000
FIXED = 9


@dataclass(frozen=True)
class Field:
    group: str  # INFO or FORMAT
    name: str
    number: str
    type: str
    description: str

    @property
    def column(self) -> str:
        return ("info:" if self.group == "INFO" else "sample:") + self.name

    @property
    def is_list(self) -> bool:
        return self.number not in ("0", "1")


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The first lines of one file, which start with #, up to that of the samples; no more of the file is read than needed."""
    text, n = spark.read.text(path), 1000
    while True:
        lines = [r["value"] for r in text.take(min(n, MAX_LINES + 1))]
        top = list(takewhile(lambda line: line.startswith("#"), lines))
        last = next((i for i, line in enumerate(top) if line.startswith("#CHROM")), None)
        if last is not None:
            return top[: last + 1]
        if len(top) < len(lines) or len(lines) < n:
            return top
        if n > MAX_LINES:
            raise ValueError(f"{path} has more than {MAX_LINES} header lines")
        n *= 10


def release_of(header: list[str], default: int = 75) -> int:
    """The gene database's release that a header names in its reference or assembly lines, else the default."""
    for line in header:
        if (m := re.match(r"##(?:reference|assembly|ensembl)[^=]*=.*?(?:release|ensembl)[-_ ]?([0-9]{2,3})(?![0-9])", line, re.I)):
            return int(m[1])
    return default


def sortable(f: Field, seen: bool) -> bool:
    """Whether clients may sort by a field: numbers, one of them in a record, and some value in the run."""
    return f.type.lower() in ("integer", "float") and f.number == "1" and seen


def samples(header: list[str]) -> list[str]:
    """Names after FORMAT in the #CHROM line, which may be separated by tabs or spaces."""
    for line in header:
        if line.startswith("#CHROM"):
            return re.split(r"\t+| +", line.strip())[FIXED:]
    raise ValueError("there is no #CHROM line")


def fields(header: list[str]) -> list[Field]:
    return [Field(m[1], m[2], m[3], m[4], m[5] or "") for line in header if (m := _DECLARED.match(line))]


def query_types(header: list[str]) -> dict[str, str]:
    """Query types of columns, by the header's declarations."""
    return {f.column: f.type.lower() for f in fields(header)} | {"position": "integer"}


def spec(spark: SparkSession, header: list[str], extant: list[str]) -> DataFrame:
    """One row per column to show: declared fields that are extant, the sample's name and the annotations.

    (supercolumn, subcolumn, column_name, path, type, number, description, sortable, ord)
    """
    there, rows = set(extant), []
    for f in fields(header):
        if f.column in there:
            top = "INFO" if f.group == "INFO" else "SAMPLE"
            rows.append((top, f.name, f.column, [top, f.name], f.type.lower(), f.number, f.description, sortable(f, True)))
    rows.append(("SAMPLE", "name", "sample_name", ["SAMPLE", "name"], "string", "1", "Sample Name", False))
    for c in ANNOTATIONS:
        if c in there:
            rows.append(("annotations", c.partition(":")[2], c, c.split(":"), "string", "1", "", False))
    schema = "supercolumn string, subcolumn string, column_name string, path array<string>, type string, number string, description string, sortable boolean, ord int"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def query_columns(header: list[str], extant: list[str]) -> list[str]:
    """Columns that query text may name."""
    names = [f.column for f in fields(header) if f.column in set(extant)]
    return ["reference", "alternates", "contig", "position", *names, "sample_name", *[c for c in ANNOTATIONS if c in extant]]


def known(f: Field) -> bool:
    return f.name in (INFO if f.group == "INFO" else SAMPLE)
