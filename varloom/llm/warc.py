"""WARC archives of pages, read back into a globally ordered index of captures.

Writing is native: each record is a string of headers and payload, and Spark's text writer with the record separator as
line separator makes every part file a gzip-compressed WARC file.  Pages are written in classes of payload size, each with
its own number of records in a file (CLASSES), so that no archive of several records holds more than about 256 MB.  Of
records with equal payloads of at least MIN_REVISIT bytes, those with the largest id are responses and the others revisits
without payload.  An archive is one gzip stream; a capture's position is that in its uncompressed bytes.

Reading parses each archive by Content-Length, so payloads may hold any text, also of record headers.  The captures of one
archive, sorted by URL key, time and id, are a run.  The index merges the runs externally: the key space is cut into
ranges by sampled keys (so that a hot URL is cut too, by time and id), and each range is one k-way merge of its slices of
all runs through a loser tree, written in order.  No task holds more than one range.

Defined results: a null payload is empty, a null URL is written as `-`, a null id as nothing and read back as null; rows
with equal ids and payloads are one record each; an empty table gives no archive and an empty index.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.base import bounded_batches, scratch, written

#: Payloads shorter than this are never revisits.
MIN_REVISIT = 1000
#: Classes of payloads: most bytes of one, and records in one archive.
CLASSES = ((1 << 16, 4000), (1 << 22, 64), (1 << 31, 1))
#: Repeated payloads up to which their table is broadcast; more are joined by digest.
BROADCAST_ROWS = 100_000
#: Stands for a null id where rows are joined by id and digest.
NO_ID = -(1 << 63)
#: Captures in one range of the index.
RANGE_ROWS = 200_000
#: Time of capture id 0; the table has none of its own.
EPOCH = 1_704_067_200

_END = "\r\n\r\n"

CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, position long"
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> tuple[DataFrame, int]:
    """The record of each page (`value`) with its payload's bytes (`n`); and the most bytes of a payload."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload")
    ).withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "n": F.octet_length("payload")})
    light = written(rows.select("id", "digest", "n"), "warc-digests")
    again = light.where(f"n >= {MIN_REVISIT}").groupBy("digest", "n").agg(F.max("id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = written(again, "warc-copies").select(F.col("digest").alias("d"), F.col("n").alias("dn"), "kept")
    same = lambda df: (df["digest"] == F.col("d")) & (df["n"] == F.col("dn"))
    if again.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(again), same(rows), "left")
    else:
        # payloads meet their copies' id by their own id, as very many may share a digest
        copies = light.distinct()
        copies = copies.join(again, same(copies)).select(F.coalesce(F.col("id"), F.lit(NO_ID)).alias("ci"), "d", "dn", "kept")
        rows = rows.join(copies, (F.coalesce(rows["id"], F.lit(NO_ID)) == F.col("ci")) & same(rows), "left")
    rows = rows.withColumn("refers", F.expr("case when kept is not null and (id is null or id <> kept) then kept end"))
    revisit = F.col("refers").isNotNull()
    uri = F.regexp_replace(F.replace(F.replace(F.coalesce("url", F.lit("-")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("n").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:capture:"), F.col("refers").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return rows.select("n", F.concat(head, block).alias("value")), light.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the pages as WARC files into a new folder, class by class; usually there is one class only."""
    records, most = _records(pages, id_col, url_col, payload_col)
    least = -1
    for size, number in CLASSES:
        if least < most:
            some = records.where(f"n > {least} and n <= {size}").select("value")
            some.write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", number).text(path)
        least = size


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the last to the first, then path and query; scheme and fragment left out."""
    rest = url.partition("#")[0]
    rest = rest.partition("://")[2] or rest
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, position) of each record of a gzip-compressed WARC file; holds one record at a time."""
    inflate = zlib.decompressobj(31)
    buffer, at, offset, used = bytearray(), 0, 0, 0

    def more() -> bool:
        nonlocal inflate, used
        if used >= len(data) and not inflate.unconsumed_tail:
            return False
        source = inflate.unconsumed_tail or data[used : (used := used + (1 << 18))]
        buffer.extend(inflate.decompress(source, 1 << 20))
        if inflate.eof and (inflate.unused_data or used < len(data)):
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            buffer.extend(inflate.decompress(rest, 1 << 20) if rest else b"")
        return True

    while True:
        while (cut := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = buffer[at:cut].decode()
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        length = int(fields["Content-Length"])
        while len(buffer) < cut + 8 + length:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield fields, bytes(buffer[cut + 4 : cut + 4 + length]), offset + at
        at = cut + 8 + length
        if at > 1 << 22:
            del buffer[:at]
            offset, at = offset + at, 0


def _capture(fields: dict[str, str], block: bytes, archive: str, position: int) -> tuple:
    number = lambda name: int(v) if (v := fields.get(name, "").partition("urn:capture:")[2].rstrip(">")) else None
    kind, payload = fields["WARC-Type"], block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"the payload at {position} of {archive} is not the one its headers name")
    url = fields["WARC-Target-URI"]
    return url_key(url), fields["WARC-Date"], number("WARC-Record-ID"), url, kind, size, digest, number("WARC-Refers-To"), archive, position


def _order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[8], c[9]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder; those of an archive are a run, in order (column `nth`)."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                archive = name.rpartition("/")[2]
                run = sorted((_capture(*r[:2], archive, r[2]) for r in parse_archive(data.as_buffer())), key=_order)
                if run:
                    columns = [*zip(*run), range(len(run))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types() + [pa.int64()])], names=[*_FIELDS, "nth"])

    return files.mapInArrow(parse, CAPTURE + ", nth long")


def _types() -> list[pa.DataType]:
    return [pa.int64() if f.split()[1] == "long" else pa.string() for f in CAPTURE.split(", ")]


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so the next item costs one match per level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = [r for r in runs if r], key
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _enter(self, i: int) -> None:
        """While the tree is built, run i climbs to the first free node; after that its winner ends at the top."""
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            run, at = self.runs[i], self.at[i]
            yield run[at]
            self.at[i] = at + 1
            self.heads[i] = self.key(run[at + 1]) if at + 1 < len(run) else None
            node = (i + self.k) // 2
            while node:
                if self._less(self.tree[node], i):
                    i, self.tree[node] = self.tree[node], i
                node //= 2
            self.tree[0] = i


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time and id: partitions in order, and rows in order within them."""
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "position")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list] = {}
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in [*_FIELDS, "nth"]]):
                slices.setdefault(row[8], []).append(row)
        for s in slices.values():
            s.sort(key=lambda r: r[-1])  # a run's slice may arrive in pieces
        out: list[tuple] = []
        for row in LoserTree(list(slices.values()), _order):
            out.append(row[:-1])
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return ranged.mapInArrow(merge, CAPTURE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types())], names=_FIELDS)


def archive_and_index(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages' archives into `path` (or a shared scratch folder), reads them back and gives the merged index."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    return merge_index(written(read_runs(spark, path), "warc-runs"))
