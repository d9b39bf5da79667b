"""Benchmark decontamination by Wu-Manber search over words.

The alphabet of the search is words, not bytes: a text is lower-cased (A-Z only) and cut into words as the contract
says.  Each benchmark item gives its windows of 13 consecutive words (or itself, if shorter).  Windows are put into
classes by length; each class has a table of shifts for blocks of two words (one where the shortest window of the class
has one word), and buckets of windows by their last block.  Sliding over a document, a block that is in no window of the
class skips as many words as no window can end in; a block with shift 0 names the windows that may end here, and these
are compared word by word.

Items are read from Spark in blocks of bounded size (BLOCK_WORDS words of windows), a longer item in pieces; each block's
tables are broadcast and searched in one pass over the documents.  A benchmark of one block (the usual case) needs no shuffle at all; with
more, the hits of all blocks are brought together by document.

Defined results: null texts and items have no words; an item without words has no window; an item without an id counts
for n_hit and contaminated, but not for n_items and items_sha256; a repeated item id counts once; equal windows of several items count for each of them; repeated documents are judged one by one.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varloom.llm.base import map_texts, written

#: Words in a window.
WINDOW = 13
#: Words in all windows of one block of items; a block's tables stay under some tens of MB.
BLOCK_WORDS = 2_000_000

#: Bytes outside words become spaces: all ASCII but digits and (lower-case) letters.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return (text or "").encode().lower().translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Multi-pattern search for windows of one or more words; `find` gives (start, end, items) of each occurrence."""

    def __init__(self, items: dict[object, list[bytes]], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], list] = defaultdict(list)
        for item, words in items.items():
            for w in dict.fromkeys(windows_of(words, size)):
                owners[w].append(item)
        classes: dict[int, list] = defaultdict(list)
        for w in owners:  # lengths 1, 2-3, 4-7, 8-12, 13: within a class the shortest sets how far a shift goes
            classes[size if len(w) == size else len(w).bit_length() - 1 - size].append(w)
        self.owners = dict(owners)
        self.searches = [self._tables(ws) for _, ws in sorted(classes.items())]

    def _tables(self, windows: list[tuple[bytes, ...]]):
        least = min(map(len, windows))
        block = min(2, least)
        shift: dict = {}
        buckets: dict = defaultdict(list)
        for w in windows:
            for end in range(block, least + 1):
                key = w[end - block : end] if block > 1 else w[end - 1]
                shift[key] = min(shift.get(key, least), least - end)
            buckets[w[least - block : least] if block > 1 else w[least - 1]].append(w)
        return least, block, shift, least - block + 1, dict(buckets)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[bytes, ...]]]:
        n = len(words)
        for least, block, shift, far, buckets in self.searches:
            end = least
            get = shift.get
            while end <= n:
                key = (words[end - 2], words[end - 1]) if block > 1 else words[end - 1]
                step = get(key, far)
                if step:
                    end += step
                    continue
                start = end - least
                for w in buckets[key]:
                    if words[start] == w[0] and tuple(words[start : start + len(w)]) == w:
                        yield start, start + len(w), w
                end += 1


def _pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """An item's words in pieces that have all its windows, each at most about BLOCK_WORDS words of windows."""
    most = max(1, BLOCK_WORDS // WINDOW)
    for low in range(0, max(1, len(words) - WINDOW + 1) if words else 0, most):
        yield words[low : low + most + WINDOW - 1]


def _items_in_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[dict[object, list[bytes]]]:
    """Items as words, in blocks of at most BLOCK_WORDS words of windows (or one piece of an item)."""
    block: dict[object, list[bytes]] = {}
    held = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).dropDuplicates()
    for row in rows.sortWithinPartitions("i").toLocalIterator():
        for words in _pieces(text_words(row["t"])):
            cost = len(words) * min(len(words), WINDOW)
            if block and held + cost > BLOCK_WORDS:
                yield block
                block, held = {}, 0
            key = row["i"] if row["i"] not in block else (row["i"], len(block))
            block[key] = words
            held += cost
    yield block


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _names(owners) -> set[str]:
    """The items' ids; items without one have no name."""
    return {n for i in owners if (n := i[0] if isinstance(i, tuple) else i) is not None}


def _judged(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words) to each row."""
    context = docs.sparkSession.sparkContext
    blocks = _items_in_blocks(benchmark, id_col, item_text)
    first = context.broadcast(WuManber(next(blocks)))
    second = next(blocks, None)
    if second is None:

        def make() -> Callable:
            search = first.value

            def work(texts: list[str]) -> dict:
                rows = []
                for t in texts:
                    words = text_words(t)
                    hits = list(search.find(words))
                    items = _names(i for *_, w in hits for i in search.owners[w])
                    rows.append((len(words), *_judged(len(words), _union([h[:2] for h in hits]), items)))
                return dict(zip(("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), map(list, zip(*rows)) if rows else [[]] * 5))

            return work

        return map_texts(docs, make, RESULT, text_col, drop_text)
    return _in_blocks(docs, first, second, blocks, text_col, drop_text)


def _in_blocks(docs, first, second, blocks, text_col, drop_text) -> DataFrame:
    """The same with several blocks of items: the hits of each block by row, brought together by row."""
    spark = docs.sparkSession
    # all columns travel in one struct, whatever their names
    keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "decontam-rows")
    own = F.col("_doc").getField
    parts = []

    def hits(search) -> DataFrame:
        def make() -> Callable:
            s = search.value

            def work(texts: list[str]) -> dict:
                spans, items = [], []
                for t in texts:
                    found = list(s.find(text_words(t)))
                    spans.append([x for h in _union([h[:2] for h in found]) for x in h])
                    items.append(sorted(_names(i for *_, w in found for i in s.owners[w])))
                return {"_spans": spans, "_items": items}

            return work

        return map_texts(keyed.select("_row", own(text_col).alias("text")), make, "_spans array<int>, _items array<string>", "text", True).where("size(_spans) > 0")

    parts.append(written(hits(first), "decontam-hits"))
    block = second
    while block is not None:
        tables = spark.sparkContext.broadcast(WuManber(block))
        parts.append(written(hits(tables), "decontam-hits"))
        tables.unpersist()
        block = next(blocks, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    new = [f.split()[0] for f in RESULT.split(", ")]
    both = keyed.join(found, "_row", "left").select("_doc", own(text_col).alias("text"), "_spans", "_items")

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t, s, i in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), b.column("_items").to_pylist()):
                n = len(text_words(t))
                s = s or []
                rows.append((n, *_judged(n, _union(list(zip(s[::2], s[1::2]))), set(i or []))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("_doc"), *made], names=["_doc", *new])

    judged = both.mapInArrow(judge, StructType([both.schema["_doc"], *StructType.fromDDL(RESULT).fields]))
    kept = [c for c in docs.columns if not (c == text_col and drop_text) and (c not in new or c == text_col)]
    return judged.select(*[own(c).alias(c) for c in kept], *new)
