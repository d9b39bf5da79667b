"""Column functions: typed cells, contig order, keys and text forms.  All are native expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of cells at query time, by the lower-case Type of a header line; any other is text.
QUERY_TYPES = {"integer": "int", "float": "double"}


def cell(name: str) -> Column:
    """A column by its exact name, which may hold colons."""
    return F.col(f"`{name}`")


def typed(name: str, kind: str = "string") -> Column:
    """A text cell as its query type; what does not parse is null."""
    target = QUERY_TYPES.get(kind.lower())
    return cell(name).try_cast(target) if target else cell(name).cast("string")


def literal(value: object, kind: str = "string") -> Column:
    """A filter's value as its query type, parsed on the driver."""
    kind = kind.lower()
    try:
        if kind == "integer":
            return F.lit(int(str(value)))
        if kind == "float":
            return F.lit(float(str(value)))
    except ValueError as error:
        raise ValueError(f"{value!r} is not of type {kind}") from error
    return F.lit(str(value))


def contig_keys(contig: Column | str = "contig") -> tuple[Column, Column, Column]:
    """Keys of the natural order of contigs: the number of a numbered contig (others 10000), length, name."""
    c = F.col(contig) if isinstance(contig, str) else contig
    numbered = c.rlike("^(chr)?[0-9]+")
    number = F.when(numbered, F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")).otherwise(F.lit(10000))
    return number, F.length(c), c


def contig_order(contig: Column | str = "contig", descending: bool = False, natural_desc: bool = False) -> list[Column]:
    """Sort columns of the natural order.

    Descending flips length and name only; the numbers flip too with `natural_desc`.
    """
    number, length, name = contig_keys(contig)
    if not descending:
        return [number.asc_nulls_last(), length.asc_nulls_last(), name.asc_nulls_last()]
    first = number.desc_nulls_first() if natural_desc else number.asc_nulls_last()
    return [first, length.desc_nulls_first(), name.desc_nulls_first()]


def row_key(prefix: str = "") -> Column:
    """`contig:position::reference->alternates`; a null part is empty."""
    p = lambda c: F.coalesce(F.col(f"{prefix}{c}").cast("string"), F.lit(""))
    return F.concat(p("contig"), F.lit(":"), p("position"), F.lit("::"), p("reference"), F.lit("->"), p("alternates"))


def vcf_cell(value: Column) -> Column:
    """A cell as VCF text: null and '' are `.`; list text loses brackets, quotes and spaces after commas."""
    text = value.cast("string")
    inner = F.regexp_replace(F.regexp_extract(text, r"^\[(.*)\]$", 1), r",\s+", ",")
    inner = F.regexp_replace(inner, r"(^|,)'([^']*)'(?=,|$)", "$1$2")
    return F.when(text.isNull() | (text == ""), F.lit(".")).when(text.rlike(r"^\[.*\]$"), inner).otherwise(text)


def effect_words(effect: Column) -> Column:
    """`FrameShiftTruncation` -> `Frame Shift Truncation`."""
    return F.regexp_replace(effect, "([a-z])([A-Z])", "$1 $2")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def task_label(kind: Column) -> Column:
    """A dotted task type without its first and last part."""
    parts = F.split(kind, r"\.")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), ".")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def preview(text: Column, size: int = 45) -> Column:
    return F.substring(text, 1, size)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def comment_link(contig: Column, position: Column) -> Column:
    """Query text of a comment's place: `contig:position-(position + 1)`."""
    return F.concat(contig, F.lit(":"), position.cast("string"), F.lit("-"), (position + 1).cast("string"))


def pileup_window(position: Column, margin: int = 25) -> Column:
    return F.struct((position - margin).alias("start"), (position + margin).alias("end"))


def igv_link(base: str, sources: list[tuple[Column, str, str]], locus: Column | None = None) -> Column:
    """Link that opens sources (URI column, name, format) in a genome viewer; null and file:// sources are left out.

    `base` is the viewer's address with its own parameters, such as `http://localhost:60151/load?genome=hg19`.
    """
    kept = F.filter(
        F.array(*[F.struct(uri.alias("file"), F.lit(name).alias("name"), F.lit(form).alias("format")) for uri, name, form in sources]),
        lambda s: s["file"].isNotNull() & ~s["file"].startswith("file://"),
    )
    joined = lambda part: F.array_join(F.transform(kept, lambda s: s[part]), ",")
    link = F.concat(F.lit(f"{base}&file="), joined("file"), F.lit("&name="), joined("name"), F.lit("&format="), joined("format"))
    return F.concat(link, F.lit("&locus="), locus) if locus is not None else link


def camel_case(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def snake_case(name: str) -> str:
    return re.sub(r"([a-z])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", name)).replace("__", "_").lower()


def _renamed(kind: T.DataType, convert) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(convert(f.name), _renamed(f.dataType, convert), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, convert), kind.containsNull)
    return kind


def rename_keys(df, convert=camel_case):
    """All column names in the other case, also those inside structs and arrays."""
    return df.select(*[cell(f.name).cast(_renamed(f.dataType, convert)).alias(convert(f.name)) for f in df.schema.fields])


def json_rows(df, convert=camel_case):
    """One column `json`: each row as JSON text with names in the other case; nulls are written."""
    renamed = rename_keys(df, convert)
    return renamed.select(F.to_json(F.struct(*[cell(c) for c in renamed.columns]), {"ignoreNullFields": "false"}).alias("json"))


def count_text(n: Column) -> Column:
    """A count with commas between thousands."""
    return F.format_number(n, 0)


def ratio_text(x: Column) -> Column:
    """A ratio with four decimals."""
    return F.format_string("%.4f", x.cast("double"))


def at_path(json: Column, *path: str) -> Column:
    """The text at a path of a JSON value; null where any part of the path is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path))
