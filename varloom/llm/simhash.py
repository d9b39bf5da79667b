"""SimHash fingerprints and their near-duplicate groups, found with tables of distances to pivots.

Equal fingerprints are one node; only different fingerprints are compared.  Each has a table of its Hamming distances to
PIVOTS reference fingerprints.  By the triangle inequality two fingerprints of which any two table entries differ by more
than the radius are no match.  That is used twice: the entries of the first NAMING pivots, in cells of CELL, are part of the
name of the file in which a fingerprint is looked for, and of the pairs in a file those whose tables differ by more are
discarded; survivors are verified by their own distance.  A fingerprint has its home in one cell and visits all that a
match's entries can lie in.  The other part of a file's name is a third of the bits: of two fingerprints that differ in 2
bits, one third at least is equal.  So no pair is lost, and a fingerprint has three homes.

Near copies may crowd one file beyond FILE_ROWS, where distances to pivots no longer tell them apart.  Fingerprints of
such files are filed again, under pairs of four blocks of 16 bits, two of which must be equal; a file that is large again
is divided by blocks of 8 bits of the other 32, and then of 4 bits of the last 16, where a file can hold 256 at most.  That
loses no pair either and bounds the comparisons however many near copies there are.

The links then give groups as connected components over fingerprints, and each document gets the least doc_id of its group.

Defined results: a text without words (null, empty, white space only) has fingerprint zero and links like any other;
texts with fewer than three words are one shingle; a null doc_id is never the least id unless all of the group's are null;
repeated rows give repeated rows.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.base import map_texts, written
from varloom.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 16
#: Pivots whose distances are part of a file's name, and distances in a cell of these.
NAMING = 2
CELL = 6
#: Fingerprints in a file beyond which it is divided anew.
FILE_ROWS = 64

#: Shingles of which bits are counted at a time.
_CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 hashes of the text's word shingles (A-Z lower-cased); no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        # big-endian bytes, highest bit first
        part = hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def add_fingerprints(docs: DataFrame, text_col: str = "text", drop_text: bool = False, out_col: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit long."""

    def make() -> Callable:
        return lambda texts: {out_col: np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64).tolist()}

    return map_texts(docs, make, f"`{out_col}` long", text_col, drop_text)


def _bits(column: str, low: int, n: int) -> str:
    return f"(shiftrightunsigned({column}, {low}) & {(1 << n) - 1}L)"


def _filed(rows: DataFrame, keys: list[str], free: str, width: int) -> DataFrame:
    """Each row once for each pair of the four blocks of `free` (an expression of `width` bits).

    A file's name is `keys` and the pair's bits; `rest` is what is free then.
    """
    n = width // 4
    files = []
    for i, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = sorted({0, 1, 2, 3} - {a, b})
        name = f"{_bits(free, a * n, n)} | shiftleft({_bits(free, b * n, n)}, {n}) | shiftleft({i}L, {2 * n})"
        rest = f"{_bits(free, c * n, n)} | shiftleft({_bits(free, d * n, n)}, {n})"
        files.append(f"struct({name} as k, {rest} as rest)")
    level = len(keys)
    kept = rows.select("fp", *keys, F.expr(f"explode(array({', '.join(files)}))").alias("f"))
    return kept.select("fp", *keys, F.col("f.k").alias(f"k{level}"), F.col("f.rest").alias("rest"))


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: fixed, spread by a hash."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)).astype(np.int64)) for i in range(n)]


def _tables(fp: str = "fp") -> str:
    """SQL: the distances to all pivots."""
    return "struct(" + ", ".join(f"cast(bit_count({fp} ^ ({p}L)) as tinyint) as p{i}" for i, p in enumerate(pivot_values())) + ")"


def _near(radius: int) -> str:
    """SQL: whether no two entries of the tables tu and tv differ by more than the radius."""
    return " and ".join(f"abs(tu.p{i} - tv.p{i}) <= {radius}" for i in range(PIVOTS))


def _close(u: DataFrame, v: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pairs u < v of rows with equal keys that the pivot tables cannot discard and whose own distance is small enough."""
    left = u.select(*keys, F.col("fp").alias("u"), F.expr(_tables()).alias("tu"))
    right = v.select(*keys, F.col("fp").alias("v"), F.expr(_tables()).alias("tv"))
    on = [left[k] == right[k] for k in keys]
    return left.join(right, on + [F.expr(f"u < v and {_near(radius)} and bit_count(u ^ v) <= {radius}")]).select("u", "v")


def homes_and_visits(fingerprints: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(fp, file) of the three homes of each fingerprint, and of all files in which its matches may have their homes."""
    thirds = ", ".join(f"shiftleft({_bits('fp', at, n)}, 2) | {i}L" for i, (at, n) in enumerate(((0, 21), (21, 21), (42, 22))))
    rows = fingerprints.select("fp", F.expr(f"explode(array({thirds}))").alias("third"), *[F.expr(f"bit_count(fp ^ ({p}L))").alias(f"d{i}") for i, p in enumerate(pivot_values(NAMING))])
    cell = lambda i, by: f"cast((d{i} + {by} + {CELL}) div {CELL} as long)"
    names, home = "array(third)", "third"
    for i in range(NAMING):
        names = f"flatten(transform({names}, n -> transform(sequence({cell(i, -radius)}, {cell(i, radius)}), c -> shiftleft(n, 5) | c)))"
        home = f"shiftleft({home}, 5) | {cell(i, 0)}"
    return rows.select("fp", F.expr(home).alias("file")), rows.select("fp", F.expr(f"explode({names})").alias("file"))


def pair_counts(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for different fingerprints: pairs seen in files by cells, left by the pivot tables, and verified."""
    home, visit = homes_and_visits(fingerprints, radius)
    left = home.select("file", F.col("fp").alias("u"), F.expr(_tables()).alias("tu"))
    right = visit.select("file", F.col("fp").alias("v"), F.expr(_tables()).alias("tv"))
    pairs = left.join(right, (left["file"] == right["file"]) & F.expr("u < v"))
    near = F.expr(_near(radius))
    return pairs.agg(F.count("*").alias("seen"), F.count_if(near).alias("left"), F.count_if(near & F.expr(f"bit_count(u ^ v) <= {radius}")).alias("verified"))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs u < v of different fingerprints (column fp, distinct) that differ in at most `radius` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("files by thirds of the bits and by two of four equal blocks hold all pairs only up to two differing bits")
    home, visit = homes_and_visits(fingerprints.select("fp"), radius)
    large = written(visit.groupBy("file").agg(F.count("*").alias("n")).where(f"n > {FILE_ROWS}").select("file"), "simhash-large")
    if large.isEmpty():
        return _close(home, visit, ["file"], radius).distinct()
    found = _close(home.join(large, "file", "left_anti"), visit, ["file"], radius)
    crowded = written(visit.join(large, "file", "left_semi").select("fp").distinct(), "simhash-crowded")
    return found.unionByName(_links_by_blocks(crowded, radius)).distinct()


def _links_by_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs of fingerprints of crowded files."""
    found: list[DataFrame] = []
    keys: list[str] = []
    free = "fp"
    for width in (64, 32, 16):
        filed = _filed(rows, keys, free, width)
        keys = [*keys, f"k{len(keys)}"]
        if width == 16:
            found.append(_close(filed, filed, keys, radius))
            break
        filed = written(filed, "simhash-files")
        large = written(filed.groupBy(*keys).agg(F.count("*").alias("n")).where(f"n > {FILE_ROWS}").select(*keys), "simhash-large")
        if large.isEmpty():
            found.append(_close(filed, filed, keys, radius))
            break
        rest = filed.join(large, keys, "left_anti")
        found.append(_close(rest, rest, keys, radius))
        rows, free = filed.join(large, keys, "left_semi").select("fp", *keys, "rest"), "rest"
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of each document: see `grouped`."""
    marked = written(add_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", True), "simhash-docs")
    rows = grouped(marked, "_id", radius)
    return rows.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group: the least id (null last), then the least hash of the text; columns as in `docs`.

    Groups are found on ids and hashes alone; texts move once, by their own id, to meet the list of rows to keep.
    """
    key, name = F.xxhash64(F.col(f"`{text_col}`")), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    light = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), key.alias("_row_key"), name.alias("_row_name"))
    marked = written(add_fingerprints(light, "_text", True), "simhash-docs")
    group = grouped(marked, "_id", radius)
    best = group.groupBy("group_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row_key").alias("key"), F.col("_row_name").alias("name"))).alias("b"))
    kept = written(best.select(F.col("b.name").alias("_row_name"), F.col("b.key").alias("_row_key")).distinct(), "simhash-kept")
    keys = ["_row_name", "_row_key"]
    # all columns travel in one struct, whatever their names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_row_key"), name.alias("_row_name"))
    rows = packed.join(kept, keys, "left_semi")
    if not marked.groupBy(*keys).count().where("count > 1").join(kept, keys, "left_semi").isEmpty():
        rows = rows.dropDuplicates(keys)
    return rows.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def grouped(marked: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the least id of all documents that links lead to, and group_fp, the least fingerprint of these."""
    least = written(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges = written(links(least, radius), "simhash-links")
    # only fingerprints with a link need a component
    member = components(edges, "simhash-components").join(least.select(F.col("fp").alias("node"), "least"), "node")
    group = member.groupBy("component").agg(F.min("least").alias("group_least"))
    linked = member.join(group, "component").select(F.col("node").alias("fp"), "component", "group_least")
    named = least.join(linked, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id"), F.coalesce("component", "fp").alias("group_fp"))
    named = written(named, "simhash-groups")
    return marked.join(named, "fp")
