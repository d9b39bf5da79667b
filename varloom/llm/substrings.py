"""Removal of byte strings that also start in an earlier document, by interval expansion on Burrows-Wheeler transforms.

A window is a string of `length` bytes of one document.  All windows of the corpus are dealt out by content, so that equal
ones meet, in four steps; only the bytes that other documents may share travel.

1. Each window has a minimizer: the least hash of its 16-byte strings.  Consecutive windows with one minimizer are a run
   (about 18 windows).  Tasks send the minimizers (4 bytes each, packed by bucket) and learn which are in two documents.
2. Documents, in groups, cut out the runs of shared minimizers.  A group sends each different run once, with the least
   id of its documents.  A minimizer in very many places is not sent by runs: its windows are sent one by one under their
   own hash, so that no bucket has to hold all surroundings of a common passage.
3. A bucket has all windows of its minimizers.  Runs of which no other version exists are settled by their least id.  The
   others are joined to one text, its suffixes are put in order and give its Burrows-Wheeler transform.  Intervals of
   suffixes with a common prefix are read off for prefixes of 8 bytes (1 where `length` is less) and then derived for 9, 10,
   11 ... bytes: the interval of c + w is the image, under the transform's mapping, of the places of c in the interval of
   w.  That stops at `length`; what is still one interval then are equal windows, and gets the least id of its documents.
4. Groups get these ids back, and each document removes what windows of a smaller id cover.

Nothing is sampled: every window takes part.  Two different minimizers of one hash, or hashes cut short, only cost work;
windows are compared by their bytes.

Defined results: null and empty texts have no bytes and lose none; texts under `length` bytes lose none; a null id counts as
greater than all others; rows with one id do not remove from each other.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.base import bounded_batches, delete_scratch, of_planes, planes, scratch, shuffles_freed, text_shares, written

LENGTH = 50
#: Bytes of the strings whose least hash is a window's minimizer.
GRAM = 16
#: Groups of documents (batches of them) that hold a minimizer, beyond which its windows are dealt out one by one.
HOT = 4096
#: Bytes of joined runs in one transform, if no single minimizer has more.
TRANSFORM_BYTES = 1 << 20
#: Bytes of documents whose minimizers are computed at once.
CHUNK_BYTES = 1 << 20
#: Bytes of text for which there is a bucket and two groups, at least.
GROUP_BYTES = 32 << 20

_LAST = np.int64(2**63 - 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of `gram` (a power of two) bytes, by doubling."""
    h, base, step = x.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < gram:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % 2**64
        step *= 2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _spread(m: np.ndarray) -> np.ndarray:
    """Minimizers hashed once more (one to one): as minima they are small numbers, which would meet in few buckets."""
    m = (m ^ (m >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return m ^ (m >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, document, start, windows) of the runs of all documents, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = b"".join(texts)
    if len(buffer) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    gram = GRAM
    while gram > length:
        gram //= 2
    m = _least(_gram_hashes(np.frombuffer(buffer, np.uint8), gram), length - gram + 1)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    # windows that lie in one document
    doc = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    m = m[begins[doc] + at]
    if not len(m):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    new = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    return _spread(m[first]), doc[first], at[first], np.diff(np.r_[first, len(m)])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Documents in chunks of about CHUNK_BYTES, with the index of each chunk's first."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_BYTES:
            yield low, texts[low : i + 1]
            low, held = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _bucket(m: np.ndarray, bits: int) -> np.ndarray:
    return (m >> np.uint64(64 - bits)).astype(np.int64)


def _short(m: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a minimizer after those of its bucket."""
    return ((m << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0), axis=0)


def _squeezed(data: bytes) -> bytes:
    """Runs are text, of which Spark's shuffle compression alone leaves most."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


# step 1: which minimizers are in two documents


def _send_minimizers(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("g").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = []
            for low, texts in _chunks(_encoded(batch.column("text"))):
                m, doc, _, _ = runs(texts, length)
                keys.append(_distinct(m, doc + low))
            if not keys:
                continue
            m, doc = (np.concatenate(c) for c in zip(*keys))
            g = groups[doc]
            order = np.lexsort((m, g, _bucket(m, bits)))
            m, g = m[order], g[order]
            same = (m[1:] == m[:-1]) & (g[1:] == g[:-1])
            first = np.flatnonzero(np.r_[True, ~same])
            many = np.diff(np.r_[first, len(m)]) > 1
            m, g = m[first], g[first]
            b = _bucket(m, bits)
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
            rows = []
            for lo, hi in zip(cut, np.r_[cut[1:], len(b)]):
                names, counts = np.unique(g[lo:hi], return_counts=True)
                data = np.uint32(len(names)).tobytes() + names.astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()
                rows.append((int(b[lo]), data + _short(m[lo:hi], bits).tobytes() + np.packbits(many[lo:hi]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

    return run


def _distinct(m: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different minimizers of each document."""
    order = np.lexsort((m, doc))
    m, doc = m[order], doc[order]
    keep = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])] if len(m) else np.zeros(0, bool)
    return m[keep], doc[keep]


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches by their key."""
    now, held = None, []
    for batch in batches:
        names = [c for c in batch.schema.names if c != key]
        for k, *row in zip(batch.column(key).to_pylist(), *[batch.column(c).to_pylist() for c in names]):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _find_shared(most: int):
    """To each group: the minimizers of a bucket that it shares with another document; hot ones after the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shared(batches, most)

    return run


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches, "bucket"):
        values, owners, many = [], [], []
        for (data,) in rows:
            n = int(np.frombuffer(data, np.uint32, 1)[0])
            names, counts = np.frombuffer(data, np.uint32, n, 4), np.frombuffer(data, np.uint32, n, 4 + 4 * n)
            total = int(counts.sum())
            values.append(np.frombuffer(data, np.uint32, total, 4 + 8 * n))
            owners.append(np.repeat(names, counts))
            many.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + 8 * n + 4 * total))[:total].astype(bool))
        v, g, many = np.concatenate(values), np.concatenate(owners), np.concatenate(many)
        order = np.argsort(v, kind="stable")
        v, g, many = v[order], g[order], many[order]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        size = np.diff(np.r_[starts, len(v)])
        shared = (size > 1) | np.logical_or.reduceat(many, starts)
        keep, hot = np.repeat(shared, size), np.repeat(size > most, size)
        v, g, hot = v[keep], g[keep], hot[keep]
        order = np.lexsort((v, hot, g))
        v, g, hot = v[order], g[order], hot[order]
        fresh = np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])] if len(v) else np.zeros(0, bool)
        v, g, hot = v[fresh], g[fresh], hot[fresh]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        for part in range(0, len(cut), 1000):
            spans = [(lo, hi) for lo, hi in zip(cut[part : part + 1000], np.r_[cut[1:], len(g)][part : part + 1000])]
            data = [np.uint32((~hot[lo:hi]).sum()).tobytes() + v[lo:hi].tobytes() for lo, hi in spans]
            yield _rows(len(spans), g=[int(g[lo]) for lo, _ in spans], kind=[0] * len(spans), bucket=[bucket] * len(spans), data=data)


_ROW = {"g": pa.int32(), "kind": pa.int32(), "id": pa.int64(), "text": pa.string(), "bucket": pa.int32(), "data": pa.binary()}
ROW = "g int, kind int, id long, text string, bucket int, data binary"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _ROW.items()], names=list(_ROW))


# step 2: documents cut out their shared runs


def _cut_runs(bits: int, length: int):
    """Rows of kind 1: a group's different runs by bucket; of kind 2: its documents with the runs they hold; 3: without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            for g, part in _split(batch, "g"):
                if group is None or group.g != g:
                    if group is not None:
                        yield from group.sent()
                    group = _Group(g, bits, length)
                yield from group.take(part)
        if group is not None:
            yield from group.sent()

    return run


def _split(batch: pa.RecordBatch, key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    k = batch.column(key).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
    for lo, hi in zip(cut, np.r_[cut[1:], len(k)] if len(k) else []):
        yield int(k[lo]), batch.slice(int(lo), int(hi - lo))


class _Group:
    def __init__(self, g: int, bits: int, length: int):
        self.g, self.bits, self.length = g, bits, length
        self.cold: list[np.ndarray] = []
        self.hot: list[np.ndarray] = []
        self.ready = False
        self.entries: dict[tuple[int, bytes], int] = {}  # (key, string) -> number
        self.least: list[int] = []

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds = part.column("kind").to_numpy(zero_copy_only=False)
        n = int((kinds == 0).sum())
        for b, d in zip(part.column("bucket").to_pylist()[:n], part.column("data").to_pylist()[:n]):
            v = np.frombuffer(d, np.uint32, offset=4).astype(np.uint64) | (np.uint64(b) << np.uint64(32))
            cold = int(np.frombuffer(d, np.uint32, 1)[0])
            self.cold.append(v[:cold])
            self.hot.append(v[cold:])
        if n == len(kinds):
            return
        if not self.ready:
            none = np.zeros(0, np.uint64)
            self.cold, self.hot = (np.sort(np.concatenate([none, *x])) for x in (self.cold, self.hot))
            self.ready = True
        docs = part.slice(n)
        ids, column = docs.column("id").to_numpy(zero_copy_only=False), docs.column("text")
        texts = _encoded(column)
        held = []
        for low, chunk in _chunks(texts):
            held += self.cut(chunk, ids[low : low + len(chunk)])
        yield _rows(len(texts), g=[self.g] * len(texts), kind=[2 if h else 3 for h in held], id=ids, text=column, data=held)

    def cut(self, texts: list[bytes], ids: np.ndarray) -> list[bytes]:
        m, doc, at, n = runs(texts, self.length)
        key = (_bucket(m, self.bits).astype(np.uint64) << np.uint64(32)) | _short(m, self.bits)
        cold, hot = _member(key, self.cold), _member(key, self.hot)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        entries, least, over = self.entries, self.least, self.length - 1
        some = np.flatnonzero(cold)
        for k, d, a, w in zip(m[some].tolist(), doc[some].tolist(), at[some].tolist(), n[some].tolist()):
            e = entries.setdefault((k, texts[d][a : a + w + over]), len(least))
            if e == len(least):
                least.append(int(ids[d]))
            elif ids[d] < least[e]:
                least[e] = int(ids[d])
            out[d].append((a, e))
        some = np.flatnonzero(hot)
        for d, a, w in zip(doc[some].tolist(), at[some].tolist(), n[some].tolist()):
            for i in range(a, a + w):
                s = texts[d][i : i + self.length]
                e = entries.setdefault((_string_hash(s), s), len(least))
                if e == len(least):
                    least.append(int(ids[d]))
                elif ids[d] < least[e]:
                    least[e] = int(ids[d])
                out[d].append((i, e))
        return [_packed_places(np.array(o, np.uint32).reshape(-1, 2)) for o in out]

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            return
        keys = np.array([k for k, _ in self.entries], np.uint64)
        strings = [s for _, s in self.entries]
        least = np.array(self.least, np.int64)
        b = _bucket(keys, self.bits)
        order = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
        rows = []
        for lo, hi in zip(cut, np.r_[cut[1:], len(order)]):
            e = order[lo:hi]
            some = [strings[i] for i in e]
            sizes, short = np.array([len(s) for s in some], np.uint32), _short(keys[e], self.bits)
            data = b"".join([np.uint32(len(e)).tobytes(), planes(_deltas(e), 4), planes(sizes, 4), planes(short, 4), planes(least[e], 8), *some])
            rows.append((int(b[e[0]]), _squeezed(data)))
        for i in range(0, len(rows), 500):
            part = rows[i : i + 500]
            yield _rows(len(part), g=[self.g] * len(part), kind=[1] * len(part), bucket=[r[0] for r in part], data=[r[1] for r in part])


def _packed_places(places: np.ndarray) -> bytes:
    """Rows of (start, number of the run), as differences modulo 2**32 and byte by byte."""
    return _deltas(places).view(np.uint8).reshape(-1, 8).T.tobytes()


def _places(data: bytes) -> np.ndarray:
    deltas = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint32)
    return np.cumsum(deltas, axis=0, dtype=np.uint32)


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def _string_hash(s: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


# step 3: least ids of equal windows


def _words(x: np.ndarray, width: int) -> np.ndarray:
    """The `width` (1, 2, 4 or 8) bytes from each place on as a number; zeros follow the end."""
    w, have = x.astype(np.uint64), 1
    while have < width:
        w <<= np.uint64(8 * have)
        w[:-have] |= w[have:] >> np.uint64(8 * have)
        have *= 2
    return w


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of x in the order of their first `depth` bytes (as if zeros followed the end)."""
    n, have = len(x), 8
    w = _words(x, have)
    while True:
        order = np.argsort(w)
        if have >= depth:
            return order
        sorted_ = w[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]), dtype=np.uint64)
        # three ranks fit one number where 21 bits hold each
        ways = 3 if n < (1 << 21) - 1 else 2
        last = min(have * ways, depth) - have
        w = rank * np.uint64(n + 1)
        w[: -min(have, last)] += rank[min(have, last) :]
        if ways == 3 and last > have:
            w *= np.uint64(n + 1)
            w[:-last] += rank[last:]
        have += last


def expand_intervals(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in order begins a new interval of suffixes with a common prefix of `depth` bytes.

    `ahead` maps a place of the transform's first column to that of the suffix one byte shorter; it is the inverse of
    the mapping from last to first column.  Two neighbours with the same first byte belong to one interval for prefixes of
    k + 1 bytes if their images belong to one for k bytes.  All intervals of one prefix length are derived at once, from
    those of 8 bytes (1 byte where `depth` is less) on, and neighbours that are apart already are not looked at again.
    """
    n, seed = len(x), 8 if depth >= 8 else 1
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = n  # the empty suffix has an interval of its own
    ahead = place[order + 1]
    first = _words(x, seed)[order]
    apart = np.ones(n + 1, bool)
    apart[1:n] = first[1:] != first[:-1]
    live = np.flatnonzero(~apart).astype(np.int32)
    own, other = ahead[live], ahead[live - 1]
    for _ in range(depth - seed):
        if not len(live):
            break
        interval = np.cumsum(apart, dtype=np.int32)
        same = interval[own] == interval[other]
        if not same.all():
            apart[live[~same]] = True
            live, own, other = live[same], own[same], other[same]
    return apart[:n]


def window_minima(strings: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all strings, one string after another: the least id of the strings that hold an equal one."""
    x = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    order = suffix_order(x, length)
    apart = expand_intervals(x, order, length)
    end = np.repeat(np.cumsum(sizes), sizes)
    is_window = end - np.arange(len(x)) >= length
    value = np.where(is_window, np.repeat(ids, sizes), _LAST)[order]
    starts = np.flatnonzero(apart)
    least = np.minimum.reduceat(value, starts)
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[starts, len(x)]))
    return out[is_window]


def _settle(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, "bucket"):
            yield from _settle_bucket(bucket, rows, length)

    return run


def _settle_bucket(bucket: int, rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int, bytes], int] = {}
    least: list[int] = []
    owners = []  # (group, entry numbers there, numbers here)
    for g, data in rows:
        data = _unsqueezed(data)
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        e, sizes = np.cumsum(of_planes(data, n, 4, 4)), of_planes(data, n, 4, 4 + 4 * n)
        keys, ids = of_planes(data, n, 4, 4 + 8 * n).tolist(), of_planes(data, n, 8, 4 + 12 * n).view(np.int64).tolist()
        at, here = 4 + 20 * n, []
        for k, i, size in zip(keys, ids, sizes.tolist()):
            u = known.setdefault((k, data[at : at + size]), len(least))
            at += size
            if u == len(least):
                least.append(i)
            elif i < least[u]:
                least[u] = i
            here.append(u)
        owners.append((g, e, np.array(here, np.int64)))
    strings = [s for _, s in known]
    ids = np.array(least, np.int64)
    windows = np.array([len(s) for s in strings], np.int64) - length + 1
    begins = np.cumsum(windows) - windows
    minima = np.repeat(ids, windows)
    # runs of minimizers with several versions, minimizer by minimizer
    keys = np.array([k for k, _ in known], np.uint64)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    held, size = [], 0
    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(order)].tolist()):
        if hi - lo > 1:
            held += order[lo:hi].tolist()
            size += sum(len(strings[i]) for i in order[lo:hi])
        if size >= TRANSFORM_BYTES:
            _put(minima, begins, windows, held, window_minima([strings[i] for i in held], ids[held], length))
            held, size = [], 0
    if held:
        _put(minima, begins, windows, held, window_minima([strings[i] for i in held], ids[held], length))
    # back to the groups: for each run of theirs, stretches of windows with one least id
    new = np.ones(len(minima), bool)
    new[1:] = minima[1:] != minima[:-1]
    new[begins] = True
    stretch = np.flatnonzero(new)
    stretch_size = np.diff(np.r_[stretch, len(minima)])
    first = np.searchsorted(stretch, begins)
    count = np.diff(np.r_[first, len(stretch)])
    for i in range(0, len(owners), 500):
        part, data = owners[i : i + 500], []
        for _, e, here in part:
            c = count[here]
            at = np.repeat(first[here], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            data.append(_squeezed(b"".join([np.uint32(len(e)).tobytes(), planes(_deltas(e), 4), planes(c, 4), planes(stretch_size[at], 4), planes(minima[stretch[at]], 8)])))
        yield _rows(len(part), g=[o[0] for o in part], kind=[1] * len(part), bucket=[bucket] * len(part), data=data)


def _put(minima, begins, windows, held, found) -> None:
    n = windows[held]
    minima[np.repeat(begins[held], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = found


# step 4: documents remove what is covered


def _remove(length: int):
    """Rows of a group: first the least ids of its runs (kind 1), then its documents (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answer = None, None
        for batch in batches:
            for g, part in _split(batch, "g"):
                if g != now:
                    now, answer = g, _Answers()
                kinds = part.column("kind").to_numpy(zero_copy_only=False)
                n = int((kinds == 1).sum())
                answer.raw += part.column("data").to_pylist()[:n]
                docs = part.slice(n)
                if not len(docs):
                    continue
                answer.prepare()
                kept, starts, ends = [], [], []
                ids = docs.column("id").to_numpy(zero_copy_only=False)
                for i, text, held in zip(ids, _encoded(docs.column("text")), docs.column("data").to_pylist()):
                    a, b = answer.spans(held, i, length)
                    starts.append(a)
                    ends.append(b)
                    kept.append(_without(text, a, b))
                spans = [[{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist())] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [docs.column("id"), pa.array([len(k) + int((b - a).sum()) for k, a, b in zip(kept, starts, ends)], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _SPANS)],
                    names=["id", "n_bytes", "kept", "spans"],
                )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return text
    return b"".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])])


class _Answers:
    """Stretches of windows and their least ids, by a group's own numbers of runs."""

    def __init__(self):
        self.raw: list[bytes] = []
        self.first = None

    def prepare(self) -> None:
        if self.first is not None:
            return
        e, c, size, least = [], [], [], []
        for data in self.raw:
            data = _unsqueezed(data)
            n = int(np.frombuffer(data, np.uint32, 1)[0])
            e.append(np.cumsum(of_planes(data, n, 4, 4)))
            c.append(of_planes(data, n, 4, 4 + 4 * n))
            total = int(c[-1].sum())
            size.append(of_planes(data, total, 4, 4 + 8 * n))
            least.append(of_planes(data, total, 8, 4 + 8 * n + 4 * total))
        e, c, self.size, self.least = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (e, c, size, least))
        at = np.cumsum(c) - c
        self.first, self.count = np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)
        self.first[e], self.count[e] = at, c
        self.raw = []

    def spans(self, held: bytes, own: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the bytes to remove from the document with id `own`, joined and in order."""
        pairs = _places(held).astype(np.int64)
        none = np.zeros(0, np.int64)
        if not len(pairs):
            return none, none
        at, e = pairs[:, 0], pairs[:, 1]
        c = self.count[e]
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        i = np.repeat(self.first[e], c) + inner
        size = self.size[i]
        before = np.cumsum(size) - size
        begin = np.repeat(at, c) + before - np.repeat(before[np.cumsum(c) - c], c)
        low = self.least[i] < own
        a, b = begin[low], begin[low] + size[low] + length - 1
        if not len(a):
            return none, none
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.r_[True, a[1:] > b[:-1]]
        first = np.flatnonzero(new)
        return a[first], b[np.r_[first[1:] - 1, len(b) - 1]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, kept binary, spans array<struct<start, end>>) for each document.

    kept is the document's UTF-8 bytes without those covered by a string of `length` bytes that also starts in a document
    with a smaller id; spans are the maximal removed stretches of bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # buckets and groups hold a bounded part of the input; a row of packed runs per group and bucket: few enough of both
    parts = text_shares(docs, text_col, GROUP_BYTES)
    groups, bits = 2 * parts, max(4, (parts - 1).bit_length())
    rows = docs.select(
        F.expr(f"cast(pmod(xxhash64(`{id_col}`, length(`{text_col}`)), {groups}) as int)").alias("g"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("id"),
        F.col(text_col).alias("text"),
    )
    sent = rows.select("g", "text").mapInArrow(_send_minimizers(bits, length), "bucket int, data binary")
    shared = sent.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_find_shared(hot), ROW)
    # a group's shared minimizers (kind 0) come before its documents (kind 1)
    whole = rows.selectExpr("g", "1 as kind", "id", "text", "cast(null as int) as bucket", "cast(null as binary) as data")
    both = shared.unionByName(whole).repartitionById(parts, "g").sortWithinPartitions("g", "kind")
    path = scratch(spark, "substring-runs")
    with shuffles_freed(spark):
        both.mapInArrow(_cut_runs(bits, length), ROW).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    cut = spark.read.schema(ROW).parquet(path)
    entries = cut.where("kind = 1").select("bucket", "g", "data")
    answers = entries.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(length), ROW)
    answers = written(answers, "substring-answers")
    # the runs have been answered: their files make room for the documents
    delete_scratch(spark, f"{path}/kind=1")
    cut = spark.read.schema(ROW).parquet(path)
    last = answers.unionByName(cut.where("kind = 2")).repartitionById(parts, "g").sortWithinPartitions("g", "kind")
    out = last.mapInArrow(_remove(length), "id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    # documents that share nothing stay where they are
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    untouched = cut.where("kind = 3").select("id", F.length(whole).cast("long").alias("n_bytes"), whole.alias("kept"), F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"))
    out = out.unionByName(untouched)
    return out.select(F.nullif("id", F.lit(int(_LAST))).alias(id_col), "n_bytes", "kept", "spans")
