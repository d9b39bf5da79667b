"""Sequence reads in binary alignment files: a data source that writes them with an index, and reads by interval.

    register(spark)
    write_reads(reads, "hdfs:///reads/7")                                  # files in the order of contig and start
    spark.read.format("reads").load("hdfs:///reads/7").where("contig = '20' and start < 2000 and end > 1000")

A file's index has, for each contig, the bins of a tree of intervals with the ranges of virtual offsets in which their reads
lie, and the first offset of each window.  Filters on contig, start and end are pushed into the source: a task per file
asks its index for the bins that the interval touches and decompresses only these ranges.  Scans without an interval
divide long files at offsets that the index names.

Starts count from 0 and intervals are half-open.  A null contig or start is an unplaced read: it lies at the end and no
interval finds it.  Reads of one key keep no order.  Null names, sequences and qualities are empty.
"""
from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from varloom.functions import contig_order
from varloom.sources import bgzf
from varloom.sources.paths import files_of, system_of

_NUMBERS = ("start", "end", "flag", "mapping_quality")
READS = StructType([StructField(c, IntegerType() if c in _NUMBERS else StringType()) for c in ("contig", "start", "end", "name", "flag", "mapping_quality", "cigar", "sequence", "quality")])
# Fixed values of the format: letters of operations and bases by their codes, and operations that cover the contig.
OPERATIONS, BASES, COVERING = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", "MDN=X"
FLAG_UNMAPPED, NO_QUALITY = 4, 0xFF
#: Bins: a tree of 6 levels, eight below each, the smallest of 2**14 bases; windows are as large as the smallest bins.
LEVELS, SMALLEST = 6, 14
LONGEST = 1 << SMALLEST + 3 * (LEVELS - 1)
#: Contigs of a set of files: each file names all of them.
MAX_CONTIGS = 1_000_000
#: Compressed bytes of a task that scans without an interval, and reads in a batch.
SPLIT_BYTES, BATCH = 64 << 20, 10_000
#: Reads that are encoded at once.
PIECE = 2_000
#: What each read has before its name, with the length of all that follows.
_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("start", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigar", "<u2"), ("flag", "<u2"), ("bases", "<u4"), ("next_ref", "<i4"), ("next_start", "<i4"), ("length", "<i4")])
_CODES = np.array([max(0, BASES.find(chr(i))) if chr(i) in BASES else len(BASES) - 1 for i in range(128)], "u1")
#: The bin of reads without a place: what the format has for an interval of no bases before the first.
_NO_BIN = (8 ** (LEVELS - 1) - 1) // 7 - 1


def _first_bin(level: int) -> int:
    return (8**level - 1) // 7


def _shift(level: int) -> int:
    return SMALLEST + 3 * (LEVELS - 1 - level)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds the interval."""
    last = max(start, end - 1)
    level = next(n for n in reversed(range(LEVELS)) if start >> _shift(n) == last >> _shift(n))
    return _first_bin(level) + (start >> _shift(level))


def bins_of_reads(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin of each interval."""
    last, out = np.maximum(start, end - 1), np.zeros(len(start), np.int64)
    for level in range(LEVELS):
        within = start >> _shift(level) == last >> _shift(level)
        out[within] = _first_bin(level) + (start[within] >> _shift(level))
    return out


def bins_of(start: int, end: int) -> list[int]:
    """All bins that the interval touches."""
    last = max(start, end - 1)
    return [_first_bin(n) + i for n in range(LEVELS) for i in range(start >> _shift(n), (last >> _shift(n)) + 1)]


def covered(cigar: list[tuple[int, str]]) -> int:
    return sum(n for n, op in cigar if op in COVERING)


def parsed_cigar(text: str | None) -> list[tuple[int, str]]:
    found = [(int(n), op) for n, op in re.findall(rf"(\d+)([{OPERATIONS}])", text or "")]
    if "".join(f"{n}{op}" for n, op in found) != (text or "").replace("*", ""):
        raise ValueError(f"{text!r} is no cigar")
    return found


@dataclass
class Index:
    """For each contig: bin -> ranges of virtual offsets, and the first offset of a read in each window."""

    bins: list[dict[int, list[list[int]]]]
    windows: list[dict[int, int]]

    def add(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, after: np.ndarray) -> None:
        """Adds reads with a place, in order; reads of one bin that follow each other are one range."""
        if not len(ref):
            return
        bins = bins_of_reads(start, end)
        new = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (bins[1:] != bins[:-1]) | (at[1:] != after[:-1])]))
        last = np.concatenate([new[1:], [len(ref)]]) - 1
        for r, b, low, high in zip(ref[new].tolist(), bins[new].tolist(), at[new].tolist(), after[last].tolist()):
            ranges = self.bins[r].setdefault(b, [])
            if ranges and ranges[-1][1] == low:
                ranges[-1][1] = high
            else:
                ranges.append([low, high])
        # starts ascend, so a read is the first in those of its windows that lie beyond all reads before it
        first, final = start >> SMALLEST, np.maximum(start, end - 1) >> SMALLEST
        contigs = np.concatenate([[0], np.flatnonzero(ref[1:] != ref[:-1]) + 1, [len(ref)]]).tolist()
        for low, high in zip(contigs, contigs[1:]):
            windows = self.windows[int(ref[low])]
            reach = np.maximum.accumulate(np.concatenate([[next(reversed(windows), -1)], final[low:high]]))
            for i in np.flatnonzero(final[low:high] > reach[:-1]).tolist():
                for w in range(max(int(first[low + i]), int(reach[i]) + 1), int(final[low + i]) + 1):
                    windows[w] = int(at[low + i])

    def to_bytes(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(bins)))
            for b, ranges in sorted(bins.items()):
                out.append(struct.pack("<Ii", b, len(ranges)) + b"".join(struct.pack("<QQ", *r) for r in ranges))
            n, seen = max(windows, default=-1) + 1, 0
            out.append(struct.pack("<i", n))
            for w in range(n):
                seen = windows.get(w, seen)
                out.append(struct.pack("<Q", seen))
        return b"".join(out)

    @classmethod
    def of_bytes(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("no index")
        at, out = 8, cls([], [])
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins: dict[int, list[list[int]]] = {}
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                b, k = struct.unpack_from("<Ii", data, at)
                bins[b] = [list(struct.unpack_from("<QQ", data, at + 8 + 16 * i)) for i in range(k)]
                at += 8 + 16 * k
            (n,) = struct.unpack_from("<i", data, at)
            out.windows.append(dict(enumerate(struct.unpack_from(f"<{n}Q", data, at + 4))))
            out.bins.append(bins)
            at += 4 + 8 * n
        return out

    def ranges(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of offsets in which reads that overlap the interval lie, joined where they meet."""
        windows = self.windows[ref]
        least = windows.get(start >> SMALLEST, 0) if windows else 0
        found = sorted((max(a, least), b) for n in bins_of(start, min(end, LONGEST)) for a, b in self.bins[ref].get(n, ()) if b > least)
        out: list[list[int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [tuple(r) for r in out]

    def cuts(self) -> list[int]:
        """Offsets at which reads begin."""
        return sorted({r[0] for bins in self.bins for ranges in bins.values() for r in ranges} | {at for w in self.windows for at in w.values() if at})


@dataclass
class Encoded:
    """Reads as bytes, one after the other between `offsets`, with their contigs and intervals (-1 where they are not placed)."""

    data: memoryview
    offsets: np.ndarray
    ref: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _pieces(data: bytes, lengths: np.ndarray) -> pa.Array:
    """An array of the data, cut into pieces of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cigars(texts: pa.Array, plain: np.ndarray, length: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cigars as bytes, their numbers of operations and the bases that they cover.  `plain` reads that have none match over `length`."""
    found = texts.dictionary_encode()
    parsed = [parsed_cigar(x) for x in found.dictionary.to_pylist()] + [[]]
    codes = found.indices.fill_null(len(parsed) - 1).to_numpy(zero_copy_only=False)
    count, over = np.array([len(c) for c in parsed])[codes], np.array([covered(c) for c in parsed])[codes]
    plain = plain & (count == 0)
    if len(parsed) > 1:
        own = pa.array([b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in c) for c in parsed], pa.large_binary()).take(pa.array(codes))
    else:
        own = pa.scalar(b"", pa.large_binary())
    over, count = np.where(plain, length, over), np.where(plain, 1, count)
    matches = _pieces((np.where(plain, length, 0) << 4 & 0xFFFFFFFF).astype("<u4").tobytes(), np.full(len(plain), 4))
    return pc.if_else(pa.array(plain), matches, own), count, over


def _bases(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Sequences as bytes, two bases in each, and their numbers of bases."""
    texts = [(x or "").upper().replace("*", "") for x in texts]
    n = np.array([len(x) for x in texts], np.int64)
    size = (n + 1) // 2
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    codes = np.zeros(2 * int(size.sum()), "u1")
    codes[np.repeat(2 * (np.cumsum(size) - size) - (np.cumsum(n) - n), n) + np.arange(len(letters))] = np.where(letters < 128, _CODES[np.minimum(letters, 127)], len(BASES) - 1)
    return _pieces((codes[::2] << 4 | codes[1::2]).tobytes(), size), n


def _marks(texts: list[str | None], n: np.ndarray) -> pa.Array:
    """Qualities as bytes, one for each base."""
    if not n.any() and not any(x and x != "*" for x in texts):
        return _pieces(b"", n)
    marks = [bytes(ord(c) - 33 for c in x) if x and (x != "*" or k == 1) else bytes([NO_QUALITY]) * k for x, k in zip(texts, n.tolist())]
    if any(len(m) != k for m, k in zip(marks, n.tolist())):
        raise ValueError("a quality has as many marks as the sequence has bases")
    return _pieces(b"".join(marks), n)


def encoded(rows: pa.RecordBatch, place: dict[str, int]) -> Encoded:
    """Reads as bytes; `place` numbers the contigs."""
    count = rows.num_rows
    column = lambda c: rows.column(c) if c in rows.schema.names else pa.nulls(count, pa.int32() if c in _NUMBERS else pa.string())
    valid = lambda c: column(c).is_valid().to_numpy(zero_copy_only=False)
    number = lambda c: column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    contigs = column("contig").dictionary_encode()
    ref = np.array([*[place[c] for c in contigs.dictionary.to_pylist()], -1], np.int64)[contigs.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    placed = (ref >= 0) & valid("start")
    start = np.where(placed, number("start"), -1)
    if (placed & (start < 0)).any():
        raise ValueError("positions count from 0")
    length = np.where(placed & valid("end"), number("end") - start, 0)
    cigar, operations, over = _cigars(column("cigar"), length > 0, length)
    end = np.where(placed, start + np.maximum(1, over), 0)
    if (end > LONGEST).any():
        raise ValueError(f"positions reach {LONGEST} at most")
    names = column("name").fill_null("").cast(pa.large_binary())
    names = pc.if_else(pc.equal(pc.binary_length(names), 0), pa.scalar(b"*", pa.large_binary()), names)
    letters = pc.binary_length(names).to_numpy(zero_copy_only=False)
    if (letters > 254).any():
        raise ValueError("names have 254 bytes at most")
    sequences, bases = _bases(column("sequence").to_pylist())
    qualities = _marks(column("quality").to_pylist(), bases)
    flag = np.where(valid("flag"), number("flag"), np.where(placed, 0, FLAG_UNMAPPED))
    head = np.zeros(count, _HEAD)
    for name, values in (("mapq", number("mapping_quality")), ("flag", flag), ("cigar", operations)):
        if ((values < 0) | (values > np.iinfo(_HEAD[name]).max)).any():
            raise ValueError(f"a read's {name} is out of its range")
        head[name] = values
    head["size"] = _HEAD.itemsize - 4 + letters + 1 + 4 * operations + (bases + 1) // 2 + bases
    head["ref"], head["start"], head["name"], head["bases"] = np.where(placed, ref, -1), start, letters + 1, bases
    head["bin"] = np.where(placed, bins_of_reads(start, end), _NO_BIN)
    head["next_ref"] = head["next_start"] = -1
    none, zero = pa.scalar(b"", pa.large_binary()), pa.scalar(b"\0", pa.large_binary())
    data = pc.binary_join_element_wise(_pieces(head.tobytes(), np.full(count, _HEAD.itemsize)), names, zero, cigar, sequences, qualities, none)
    _, offsets, whole = data.buffers()
    return Encoded(memoryview(whole or b""), np.frombuffer(offsets, np.int64)[data.offset : data.offset + count + 1], ref, start, end)


def decode(body: bytes, contigs: list[str]) -> tuple:
    """A read's columns, in the order of READS."""
    ref, start, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHI", body)
    at = 32 + n_name
    name = body[32 : at - 1].decode()
    cigar = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{n_cigar}I", body, at)]
    at += 4 * n_cigar
    pairs = body[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in pairs)[:n_seq]
    marks = body[at + len(pairs) : at + len(pairs) + n_seq]
    quality = "" if not marks or marks[0] == NO_QUALITY else bytes(m + 33 for m in marks).decode()
    placed = ref >= 0 and start >= 0
    text = "".join(f"{n}{op}" for n, op in cigar) or None
    return (contigs[ref] if ref >= 0 else None, start if placed else None, start + max(1, covered(cigar)) if placed else None, None if name == "*" else name, flag, mapq, text, seq, quality)


def write_header(out: bgzf.Writer, contigs: list[str]) -> None:
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{LONGEST}\n" for c in contigs)
    out.write(b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)))
    for c in contigs:
        out.write(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", LONGEST))
    out.flush()


def read_header(reader: bgzf.Reader) -> list[str]:
    """Names of the contigs; the reader is at the first read then."""
    number = lambda: struct.unpack("<i", reader.read(4))[0]
    if reader.read(4) != b"BAM\1":
        raise ValueError("no file of reads")
    reader.read(number())
    names = []
    for _ in range(number()):
        names.append(reader.read(number())[:-1].decode())
        number()
    return names


@dataclass
class Region:
    contig: str | None = None
    start: int = 0
    end: int = LONGEST

    @property
    def whole(self) -> bool:
        return self.contig is None


def load_index(system, path: str) -> Index | None:
    from pyarrow import fs

    name = f"{path}.bai"
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    with system.open_input_file(name) as f:
        return Index.of_bytes(f.read())


def read_file(system, path: str, region: Region, span: tuple[int, int] | None = None, counts: dict | None = None) -> Iterator[tuple]:
    """Reads that overlap the region, or all of the file or of a span of its offsets; `counts` gets the blocks that were read."""
    with system.open_input_file(path) as f:
        reader = bgzf.Reader(f)
        contigs = read_header(reader)
        indexed, blocks, spans = False, reader.blocks, [span or (reader.tell(), 1 << 63)]
        if not region.whole:
            if region.contig not in contigs or region.start >= region.end:
                spans = []
            elif (index := load_index(system, path)) is not None:
                indexed, spans = True, index.ranges(contigs.index(region.contig), region.start, region.end)
        past = False
        for low, high in spans:
            if past:
                break
            reader = bgzf.Reader(f, low)
            while not past and reader.tell() < high and len(size := reader.read(4)) == 4:
                row = decode(reader.read(struct.unpack("<i", size)[0]), contigs)
                if region.whole or row[0] == region.contig and row[1] is not None and row[1] < region.end and row[2] > region.start:
                    yield row
                # ranges come from an index, and files with one are in order
                past = indexed and row[0] == region.contig and row[1] is not None and row[1] >= region.end
            blocks += reader.blocks
        if counts is not None:
            counts["blocks"] = counts.get("blocks", 0) + blocks


@dataclass
class _Part(InputPartition):
    path: str
    span: tuple[int, int] | None = None


class ReadsSource(DataSource):
    """Options: path; for writing also contigs, a JSON list of all names in their order."""

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> StructType:
        return READS

    def reader(self, schema: StructType) -> ReadsReader:
        return ReadsReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ReadsWriter:
        return ReadsWriter(self.options["path"], json.loads(self.options["contigs"]), overwrite)


@dataclass
class ReadsReader(DataSourceReader):
    path: str
    split_bytes: int = SPLIT_BYTES
    region: Region = field(default_factory=Region)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An interval of one contig is answered by the index; it holds exactly the reads that pass, so nothing is left of it.

        Bounds count only together with a contig, and only those that make up an overlap; others stay with Spark.
        """
        contig = next((f for f in filters if isinstance(f, EqualTo) and f.attribute == ("contig",)), None)
        for f in filters:
            if contig is None:
                yield f
            elif isinstance(f, IsNotNull) and f.attribute in (("contig",), ("start",), ("end",)):
                continue  # reads of a contig have a place
            elif f is contig:
                self.region.contig = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.region.end = min(self.region.end, int(f.value) + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("end",):
                self.region.start = max(self.region.start, int(f.value) - isinstance(f, GreaterThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        system, _ = system_of(self.path)
        parts = []
        for path, size in files_of(self.path, ".bam"):
            index = load_index(system, path) if self.region.whole and size > self.split_bytes else None
            if index is None:
                parts.append(_Part(path))
                continue
            cuts = [index.cuts()[0]] if index.cuts() else [0]
            for at in index.cuts():
                if (at >> 16) - (cuts[-1] >> 16) >= self.split_bytes:
                    cuts.append(at)
            parts += [_Part(path, span) for span in zip(cuts, [*cuts[1:], 1 << 63])] if index.cuts() else [_Part(path)]
        return parts

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READS)
        system, _ = system_of(self.path)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for row in read_file(system, partition.path, self.region, partition.span):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


@dataclass
class ReadsWriter(DataSourceArrowWriter):
    """One file of each task that has rows; their names get their final form when all tasks have ended."""

    path: str
    contigs: list[str]
    overwrite: bool

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, folder = system_of(self.path)
        system.create_dir(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        place, out, before = {c: i for i, c in enumerate(self.contigs)}, None, -1
        index = Index([{} for _ in self.contigs], [{} for _ in self.contigs])
        for rows in (batch.slice(i, PIECE) for batch in iterator for i in range(0, batch.num_rows, PIECE)):
            if out is None:
                out = bgzf.Writer(system.open_output_stream(f"{folder}/_{name}"))
                write_header(out, self.contigs)
            reads = encoded(rows, place)
            placed = reads.start >= 0
            key = np.where(placed, reads.ref << 32 | np.maximum(reads.start, 0), len(place) << 32)
            if key[0] < before or (key[1:] < key[:-1]).any():
                raise ValueError("reads must come in the order of contig and start")
            before = key[-1]
            at, after = out.write_pieces(reads.data, reads.offsets)
            index.add(*[x[placed] for x in (reads.ref, reads.start, reads.end, at, after)])
        if out is None:
            return _Written([])
        out.close()
        with system.open_output_stream(f"{folder}/_{name}.bai") as f:
            f.write(index.to_bytes())
        return _Written([f"{name}.bai", name])

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = system_of(self.path)
        if self.overwrite:
            for path, _ in files_of(self.path):
                system.delete_file(path)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = system_of(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.delete_file(f"{folder}/_{name}")


def register(spark: SparkSession) -> None:
    """Makes format("reads") known to the session, and lets Spark push filters into such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReadsSource)


def write_reads(reads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes reads (columns of READS, of which contig, start and either end or cigar must be there) as files in order."""
    spark = reads.sparkSession
    register(spark)
    names = reads.where("contig is not null").select("contig").distinct().orderBy(*contig_order("contig"))
    contigs = [r["contig"] for r in names.limit(MAX_CONTIGS + 1).collect()]
    if len(contigs) > MAX_CONTIGS:
        raise ValueError(f"more than {MAX_CONTIGS} contigs")
    rows = reads.select(*[(F.col(f.name) if f.name in reads.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in READS])
    # one number orders all: the contig's place and the start; unplaced reads come last
    places = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(contigs)), "array<string>")).alias("_place", "_contig"))
    key = F.when(F.col("contig").isNotNull() & F.col("start").isNotNull(), F.shiftleft(F.col("_place").cast("long"), 32) + F.col("start")).otherwise((1 << 63) - 1)
    rows = rows.join(F.broadcast(places), F.col("contig") == F.col("_contig"), "left").withColumn("_key", key).drop("_place", "_contig")
    ordered = rows.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
    ordered.write.format("reads").option("contigs", json.dumps(contigs)).mode(mode).save(path)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("reads").load(path)


def search_reads(bams: DataFrame, bam: int, contig: str, start: int, end: int, root: str = "") -> DataFrame:
    """Reads of one BAM of the table (its URI is below `root`) that overlap the half-open interval."""
    from varloom.operators.calls import overlapping
    from varloom.operators.catalog import by_id

    uri = by_id(bams, bam).first()["uri"]
    return overlapping(read_reads(bams.sparkSession, root + uri), contig, start, end)
