"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays.

Texts are cut at special-token strings, then before each single space that a non-space follows: such a place is always a
boundary of the vocabulary's own pre-tokens, so each unit can be tokenized alone and remembered.  The pre-tokens of all
units that a batch brings for the first time are held as one flat array of symbols with the starts of its sequences.  In
each round every sequence finds its lowest-rank pair and merges all its occurrences at once, in all sequences
simultaneously; sequences without a pair left are counted and dropped.  As no merge makes a pair of lower rank than its
own (checked when the table is built), that gives the same symbols as merging one pair at a time.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special token's string counts as one token.
Memory: at most CACHE_UNITS remembered units in a task, and one batch of texts.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from varloom.llm.base import map_texts

#: Units remembered in a task; beyond that the memory is emptied, which only costs time.
CACHE_UNITS = 300_000
#: Longest unit that is remembered.
CACHE_CHARS = 64
#: Pre-tokens that are merged in one call hold about so many bytes.
MERGE_BYTES = 1 << 20

_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) for b in range(256)]
    spare = iter(range(256, 512))
    for b in range(256):
        if b not in plain:
            out[b] = chr(next(spare))
    return out


@dataclass
class MergeTable:
    """Pairs of symbols and their ranks in an open-addressed hash table; ids are those of the vocabulary."""

    first: np.ndarray  # id of each byte's symbol
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    probes: int
    width: int
    special: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        width = max(vocab.values()) + 1
        first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        made_at = {}
        for rank, (a, b) in enumerate(pairs):
            if max(made_at.get(a, -1), made_at.get(b, -1)) >= rank:
                raise ValueError("a merge comes before one that it needs")
            made_at.setdefault(a + b, rank)
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        table = MergeTable(first, *_hashed(keys, np.arange(len(keys), dtype=np.int32), made), width)
        table.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        return table

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair in the table, or -1."""
        key = a * self.width + b
        slot = _slot(key, len(self.keys))
        out = np.where(self.keys[slot] == key, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)


def _hashed(keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
    size = 1 << int(np.ceil(np.log2(len(keys) * 4)))
    at, out_rank, out_made = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int64)
    probes, left, slot = 0, np.arange(len(keys)), _slot(keys, size)
    while len(left):
        probes += 1
        free = left[at[slot[left]] < 0]
        _, one = np.unique(slot[free], return_index=True)
        put = free[one]
        at[slot[put]], out_rank[slot[put]], out_made[slot[put]] = keys[put], ranks[put], made[put]
        left = np.setdiff1d(left, put)
        slot[left] = (slot[left] + 1) & (size - 1)
    return at, out_rank, out_made, probes


def merge_all(table: MergeTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive in each piece: their counts, and the ids of all pieces one after another."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    counts = lengths.copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ids = table.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    while len(ids):
        inner = np.empty(len(ids), bool)
        inner[-1] = False
        inner[:-1] = owner[1:] == owner[:-1]
        rank = np.full(len(ids), _NONE, np.int32)
        slots = np.zeros(len(ids), np.int64)
        at = np.flatnonzero(inner)
        found = table.look_up(ids[at], ids[at + 1])
        rank[at] = np.where(found >= 0, table.ranks[found], _NONE)
        slots[at] = found
        starts = np.flatnonzero(np.r_[True, ~inner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        size = np.diff(np.r_[starts, len(ids)])
        over = lowest == _NONE
        if over.any():
            ended = np.repeat(over, size)
            counts[owner[starts[over]]] = size[over]
            done.append((owner[ended], ids[ended]))
            ids, owner, rank, slots, inner = (x[~ended] for x in (ids, owner, rank, slots, inner))
            lowest, size = lowest[~over], size[~over]
            if not len(ids):
                break
        chosen = rank == np.repeat(lowest, size)
        # in a run of overlapping equal pairs (a a a ...) the first, third, ... are merged
        where = np.flatnonzero(chosen)
        begins = np.r_[True, np.diff(where) != 1]
        nth = np.arange(len(where)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        where = where[nth % 2 == 0]
        ids[where] = table.made[slots[where]]
        keep = np.ones(len(ids), bool)
        keep[where + 1] = False
        ids, owner = ids[keep], owner[keep]
    if not done:
        return counts, np.zeros(0, np.int64)
    owners, out = (np.concatenate(x) for x in zip(*done))
    return counts, out[np.argsort(owners, kind="stable")]


class Counter:
    """Counts tokens of texts; remembers units."""

    #: Splits text into pre-tokens, as published with byte-level vocabularies.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, table: MergeTable):
        import regex

        self.table, self.known = table, {}
        self.find = regex.compile(self.PATTERN).findall
        self.cut = re.compile(r" (?=[^\s])").split
        marks = sorted(table.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, marks))).split if marks else None
        self.marks = marks

    def units(self, text: str) -> list[str]:
        head, *rest = self.cut(text)
        return [head, *[" " + u for u in rest]]

    def __call__(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            pieces = self.special(text) if self.special and any(m in text for m in self.marks) else [text]
            extra.append(len(pieces) - 1)
            parts.append([u for p in pieces if p for u in self.units(p)] if len(pieces) > 1 else self.units(text))
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        long = {}
        missing = [u for u in new if u not in self.known]
        for u, n in zip(missing, self.count_units(missing)):
            (self.known if len(u) <= CACHE_CHARS else long)[u] = n
        known = self.known
        return [e + sum([known[u] if u in known else long[u] for u in p]) if long else e + sum(map(known.__getitem__, p)) for p, e in zip(parts, extra)]

    def count_units(self, units: list[str]) -> list[int]:
        out = []
        group: list[bytes] = []
        owner: list[int] = []
        total = np.zeros(len(units), np.int64)
        held = 0

        def flush():
            nonlocal group, owner, held
            if group:
                counts, _ = merge_all(self.table, group)
                np.add.at(total, owner, counts)
            group, owner, held = [], [], 0

        for i, u in enumerate(units):
            for piece in self.find(u):
                b = piece.encode()
                group.append(b)
                owner.append(i)
                held += len(b)
            if held > MERGE_BYTES:
                flush()
        flush()
        out = total.tolist()
        return out


def _counter(table: MergeTable) -> Counter:
    """One counter for each worker process: what it remembers serves all its tasks."""
    if not hasattr(table, "counter"):
        table.counter = Counter(table)
    return table.counter


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > limit) to each row.

    `vocabulary` is the path of a byte-level tokenizer file on the driver; its merge table (some MB, bounded by the
    file) is broadcast, so executors need no file.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable.load(vocabulary))

    def make() -> Callable:
        count = _counter(table.value)

        def work(texts: list[str]) -> dict:
            n = count(texts)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean", text_col, drop_text)
