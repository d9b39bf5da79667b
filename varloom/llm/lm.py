"""A hashed maximum-entropy language model with class-factored softmax, and counts of word pairs.

log M(word | history) = log P(class | history) + log P(word | class).  The TOP most frequent training tokens are a class
each; all other words fall into SUFFIXES classes by a hash of their last letters, so that also words never seen have one.
Classes are factored once more, into WIDE parts of WIDE classes: P(class | history) = P(part | history) P(class | part,
history), two softmaxes of WIDE outputs.  Both are maximum-entropy models over hashed features of the history: the word
before, the one before that (skip), both as an n-gram, and the n-gram of both words' classes; in the second each feature
is joined with the part.  P(word | class) is the smoothed share of the word in its class.  The score is
P(word | history) = (c(before, word) + PRIOR M(word | history)) / (c(before) + PRIOR), with the counts c of training
documents; the word before the first is the end.  A training document's own pairs are counted too.

Tokens are keys of 64 bits, 57 of a hash and 7 of their suffix class, made for all words of a batch at once in numpy.  Two
of a million different tokens share a key with a probability under 1e-5, and are then counted as one.

Counting.  Documents are dealt into groups by id.  A group sends each different token and each different pair of tokens
(a hash of 48 bits) once, with its count in training documents, to the key's bucket; buckets add up and answer each group
with the counts of its own.  Vocabulary and pairs, which grow with the input, are thus never in one place, and the numbers
of groups and buckets grow with the input too; the driver gets sums by class and the few most frequent tokens.

Training.  ROUNDS rounds, each over another share of the training documents, all of which are used once.  In a round each
partition starts from the common weights (2.1 MB, of fixed size), makes gradient updates in mini-batches of sparse
rows, and gives its change; the changes are averaged, weighted by tokens, block by block in Spark, and only the new
weights reach the driver.  Scores therefore depend on how the documents are partitioned, as every such average does.

Defined results: a null or empty text is the end token alone; a null id counts as the text '' in the choice of held-out
documents (crc32 0: held out); with no training tokens all counts are 0 and classes are equally likely.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.base import bounded_batches, of_planes, planes, scratch, shares, shuffles_freed

TOP = 128
SUFFIXES = 128
CLASSES = TOP + SUFFIXES
#: Outputs of each of the two softmaxes.
WIDE = 16
#: Rows of the feature table; after them come the biases, one of the parts and one of each part's classes.
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
ROWS = FEATURES + 1 + WIDE
SMOOTH = 0.1
#: Counts that the class model is worth beside those of word pairs (chosen on held-out documents of even ids of sf0.1).
PRIOR = 200.0
#: Tokens of a group whose counts are summed at once.
COUNT_TOKENS = 1 << 20
ROUNDS = 3
RATE = 0.15
MINIBATCH = 8192
#: Bytes of text whose words are hashed at once.
CHUNK_BYTES = 1 << 19
#: Bytes of input for which there is a group of documents, at least.
GROUP_BYTES = 16 << 20
#: Blocks of the weights that are averaged apart.
BLOCKS = 16

_M = np.uint64(0x9E3779B97F4A7C15)
_SUFFIX_MASK = np.uint64(SUFFIXES - 1)
#: The end of a text: a key of suffix class 0.
END = np.uint64(0xE220A8397B1DCD00)

# words


def _mixed(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(31))) * _M
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STRIPPED = np.zeros(256, bool)
_STRIPPED[list(b".,;:!?")] = True
_SPACE_AT = re.compile(rb"[\x20\x09-\x0D]").search
with np.errstate(over="ignore"):
    _VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * _M)
#: A number and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th; remembered for usual sizes."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    out = []
    for x in (_BASE, _INVERSE):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    if n <= 4 * CHUNK_BYTES:
        _POWERS[:] = out
    return out


def _keys_of_piece(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of each word; the bytes begin and end with white space.

    A word's hash is the sum of its bytes' values times powers of the base, from sums over all bytes before.
    """
    space = _SPACE[x]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(x))
    sums = _VALUES[x]
    sums *= up[: len(x)]
    np.cumsum(sums, out=sums)
    sizes = ends - starts
    h = _mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] + sizes.astype(np.uint64))
    # the last three bytes, less punctuation at the end
    tail = x[ends - 1].astype(np.uint64)
    tail |= np.where(sizes > 1, x[ends - 2], 0).astype(np.uint64) << np.uint64(8)
    tail |= np.where(sizes > 2, x[ends - 3], 0).astype(np.uint64) << np.uint64(16)
    for _ in range(3):
        tail = np.where(_STRIPPED[(tail & np.uint64(255)).astype(np.int64)], tail >> np.uint64(8), tail)
    return starts, (h & ~_SUFFIX_MASK) | (_mixed(tail + _M) & _SUFFIX_MASK)


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of each word of lower-cased bytes that begin and end with white space, piece by piece."""
    found, at = [], 0
    with np.errstate(over="ignore"):
        while at < len(data) - 1:
            cut = m.start() if at + CHUNK_BYTES < len(data) and (m := _SPACE_AT(data, at + CHUNK_BYTES)) else len(data) - 1
            starts, keys = _keys_of_piece(np.frombuffer(data, np.uint8, cut + 1 - at, at))
            found.append((starts + at, keys))
            at = cut
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(none, *found)))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens (A-Z lower-cased; each text's end is one) and the number of tokens of each text."""
    parts = [(t or "").encode() for t in texts]
    data = b" " + b" ".join(parts).lower() + b" "
    spaced = np.array([len(p) + 1 for p in parts], np.int64)
    starts, words = word_keys(data)
    sizes = np.diff(np.searchsorted(starts, np.cumsum([1, *spaced]))) + 1
    ends = np.cumsum(sizes) - 1
    out = np.empty(len(words) + len(parts), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    return out, sizes


def firsts(sizes: np.ndarray) -> np.ndarray:
    """Marks the first token of each text."""
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def before_each(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each; before the first of a text that is the end."""
    out = np.roll(tokens, 1)
    out[first] = END
    return out


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """48 bits for each pair of tokens."""
    with np.errstate(over="ignore"):
        return _mixed(before * _M + tokens) >> np.uint64(16)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def held_out(id_col: str) -> str:
    """SQL: whether the document is held out."""
    return f"(crc32(coalesce(cast(`{id_col}` as string), '')) % 10 = 0)"


class Places:
    """Places of keys in a sorted array of different ones, all hashes of `width` bytes.

    Hashes are spread evenly, so a key is few places after the first one with the same upper bits.
    """

    def __init__(self, keys: np.ndarray, width: int):
        self.keys, bits = keys, max(1, (len(keys) - 1).bit_length())
        self.shift = np.uint64(8 * width - bits)
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.cumsum(sizes) - sizes

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The places of keys that are all there."""
        out = self.starts[(wanted >> self.shift).astype(np.int64)]
        before = np.flatnonzero(self.keys[out] != wanted)
        while len(before):
            out[before] += 1
            before = before[self.keys[out[before]] != wanted[before]]
        return out


# model


@dataclass
class Model:
    top: np.ndarray  # keys of the most frequent tokens, falling
    total: int  # N, training tokens
    distinct: int  # V
    class_total: np.ndarray
    class_distinct: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, WIDE), np.float32))

    def start(self) -> Model:
        """The biases start with the classes' shares."""
        share = (self.class_total + SMOOTH * (self.class_distinct + 1)).reshape(WIDE, WIDE)
        self.weights[FEATURES] = np.log(share.sum(axis=1) / share.sum())
        self.weights[FEATURES + 1 :] = np.log(share / share.sum(axis=1, keepdims=True))
        return self

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        out = (tokens & _SUFFIX_MASK).astype(np.int64) + TOP
        if len(self.top):
            order = np.argsort(self.top)
            at = np.minimum(np.searchsorted(self.top[order], tokens), len(order) - 1)
            hit = self.top[order[at]] == tokens
            out[hit] = order[at[hit]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def in_class(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """P(word | class); a top token is its whole class."""
        rest = (counts + SMOOTH) / (self.class_total[classes] + SMOOTH * (self.class_distinct[classes] + 1))
        return np.where(classes < len(self.top), 1.0, rest)


def features(tokens: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of the table for each token, for the part and then for the class in it: hashes of its history, and the bias."""
    at = np.arange(len(tokens))
    since = at - np.maximum.accumulate(np.where(first, at, 0))
    one, two = np.roll(tokens, 1), np.roll(tokens, 2)
    c1, c2 = np.roll(classes, 1) + 1, np.roll(classes, 2) + 1
    one[since < 1], two[since < 2], c1[since < 1], c2[since < 2] = 0, 0, 0, 0
    part = classes // WIDE
    with np.errstate(over="ignore"):
        salt = (part + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys = (one * _M + np.uint64(1), two * _M + np.uint64(2), (one * _M + two) * _M + np.uint64(3), (c1 * 997 + c2).astype(np.uint64) * _M + np.uint64(4))
        out = np.empty((2, len(keys) + 1, len(tokens)), np.uint16)
        for i, k in enumerate(keys):
            k ^= k >> np.uint64(31)
            out[0, i] = (k * _M) >> np.uint64(64 - FEATURE_BITS)
            out[1, i] = ((k + salt) * _M) >> np.uint64(64 - FEATURE_BITS)
    out[0, -1], out[1, -1] = FEATURES, FEATURES + 1 + part
    return out


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of all outputs (first axis) for each token."""
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    z = np.ascontiguousarray(z.T)
    z -= z.max(axis=0)
    z -= np.log(np.exp(z).sum(axis=0))
    return z


def log_class(weights: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(class | history) of each token's own class."""
    at = np.arange(len(classes))
    return log_softmax(weights, rows[0])[classes // WIDE, at] + log_softmax(weights, rows[1])[classes % WIDE, at]


def update(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One mini-batch of gradient updates: only rows of features that occur are touched, with step sizes by row."""
    n = len(classes)
    p = np.concatenate([log_softmax(weights, r) for r in rows], axis=1)
    np.exp(p, out=p)
    p[np.concatenate([classes // WIDE, classes % WIDE]), np.arange(2 * n)] -= 1
    # sums by feature row of the errors of all tokens that have it; rows that do not occur stay as they are
    flat, change = rows.transpose(1, 0, 2).ravel().astype(np.int64), np.empty((WIDE, ROWS), np.float32)
    for j, errors in enumerate(p.astype(np.float64)):
        change[j] = np.bincount(flat, np.tile(errors, rows.shape[1]), ROWS)
    squares += np.einsum("ij,ij->j", change, change) / np.float32(WIDE)
    change *= RATE / np.sqrt(1 + squares)
    weights -= change.T


# counting

_ROW = {"g": pa.int32(), "kind": pa.int32(), "id": pa.int64(), "text": pa.string(), "bucket": pa.int32(), "data": pa.binary()}
ROW = "g int, kind int, id long, text string, bucket int, data binary"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _ROW.items()], names=list(_ROW))


Counts = tuple[np.ndarray, np.ndarray]  # keys in order, and how often each occurs
#: Bytes of a key of a token and of a pair; a count has five.
_WIDTHS = (8, 6)


def _packed(tokens: Counts, pairs: Counts) -> bytes:
    sizes = np.array([len(tokens[0]), len(pairs[0])], np.uint32).tobytes()
    return sizes + b"".join(planes(x, w) for (keys, counts), k in zip((tokens, pairs), _WIDTHS) for x, w in ((keys, k), (counts, 5)))


def _unpacked(data: bytes) -> tuple[Counts, Counts]:
    out, at = [], 8
    for n, k in zip(np.frombuffer(data, np.uint32, 2).tolist(), _WIDTHS):
        out.append((of_planes(data, n, k, at), of_planes(data, n, 5, at + k * n).astype(np.int64)))
        at += (k + 5) * n
    return out[0], out[1]


def _joined(parts: list[Counts]) -> Counts:
    return np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]]), np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])


class _Seen:
    """A group's different tokens and pairs with their counts in training documents."""

    def __init__(self):
        self.parts: tuple[list[Counts], list[Counts]] = ([], [])

    def add(self, texts: list[str | None], out: np.ndarray) -> None:
        tokens, sizes = tokens_of(texts)
        train = ~np.repeat(out, sizes)
        both = tokens, pair_keys(before_each(tokens, firsts(sizes)), tokens)
        for i in range(0, len(tokens), COUNT_TOKENS):
            now = slice(i, i + COUNT_TOKENS)
            for keys, parts in zip(both, self.parts):
                parts.append(np.unique(keys[now][train[now]], return_counts=True))
                other = np.unique(keys[now][~train[now]])
                parts.append((other, np.zeros(len(other), np.int64)))
                if sum(len(k) for k, _ in parts[1:]) > max(COUNT_TOKENS, len(parts[0][0])):
                    parts[:] = [summed(*_joined(parts))]

    def packed(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, data) of each bucket that holds some of them; buckets are ranges of keys."""
        tokens, pairs = (summed(*_joined(p)) for p in self.parts)
        cuts = [np.searchsorted((keys >> np.uint64(8 * width - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)) for (keys, _), width in zip((tokens, pairs), _WIDTHS)]
        for k in range(buckets):
            (a, b), (c, d) = (cut[k : k + 2].tolist() for cut in cuts)
            if a < b or c < d:
                yield k, _packed((tokens[0][a:b], tokens[1][a:b]), (pairs[0][c:d], pairs[1][c:d]))


def _send_counts(buckets: int):
    """Rows of sorted groups -> (bucket, g, data): a group's different tokens and pairs, and their counts in training documents."""

    def sent(g: int, seen: _Seen) -> Iterator[pa.RecordBatch]:
        names, data = zip(*seen.packed(buckets))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([g] * len(names), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "g", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, _Seen()
        for g, part in _by_group(batches):
            if now is not None and g != now:
                yield from sent(now, seen)
                seen = _Seen()
            now = g
            seen.add(part.column("text").to_pylist(), part.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
        if now is not None:
            yield from sent(now, seen)

    return run


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows of one group."""
    for batch in batches:
        g = batch.column("g").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist() if len(g) else []
        for low, high in zip(cut, [*cut[1:], len(g)]):
            yield int(g[low]), batch.slice(low, high - low)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's sums: to each group the counts of its tokens and pairs, in the order of their keys (kind 0); sums by class
    and top tokens (kind 2)."""

    def settled(bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        tokens, pairs = (summed(*_joined(list(parts))) for parts in zip(*[_unpacked(data) for _, data in rows]))
        for i in range(0, len(rows), 200):
            part, out = rows[i : i + 200], []
            for _, data in part:
                found = [total[np.searchsorted(keys, own)] for (keys, total), (own, _) in zip((tokens, pairs), _unpacked(data))]
                out.append(np.array([len(n) for n in found], np.uint32).tobytes() + b"".join(planes(n, 5) for n in found))
            yield _rows(len(part), g=[g for g, _ in part], kind=[0] * len(part), bucket=[bucket] * len(part), data=out)
        known = tokens[1] > 0
        keys, counts = tokens[0][known], tokens[1][known]
        suffix = (keys & _SUFFIX_MASK).astype(np.int64)
        sums = np.array([np.bincount(suffix, counts, SUFFIXES), np.bincount(suffix, minlength=SUFFIXES)], np.float64).astype(np.int64)
        best = np.lexsort((keys, -counts))[:TOP]
        order = np.argsort(keys[best])
        top = keys[best][order], counts[best][order]
        yield _rows(1, g=[-1], kind=[2], bucket=[bucket], data=[sums.tobytes() + _packed(top, (keys[:0], counts[:0]))])

    now, held = None, []
    for batch in batches:
        for b, g, data in zip(*[batch.column(c).to_pylist() for c in ("bucket", "g", "data")]):
            if now is not None and b != now:
                yield from settled(now, held)
                held = []
            now = b
            held.append((g, data))
    if now is not None:
        yield from settled(now, held)


def _model(stats: Iterator) -> Model:
    """Sums of all buckets; each bucket has one row of fixed size."""
    sums, best = np.zeros((2, SUFFIXES), np.int64), []
    for row in stats:
        data = bytes(row["data"])
        sums += np.frombuffer(data, np.int64, 2 * SUFFIXES).reshape(2, SUFFIXES)
        keys, counts = _unpacked(data[16 * SUFFIXES :])[0]
        best = sorted([*best, *zip((-counts).tolist(), keys.tolist())])[:TOP]
    classes = np.concatenate([np.zeros((2, TOP)), sums], axis=1)
    for i, (c, key) in enumerate(best):
        classes[:, TOP + (key & (SUFFIXES - 1))] -= (-c, 1)
        classes[:, i] = (-c, 1)
    return Model(np.array([k for _, k in best], np.uint64), int(sums[0].sum()), int(sums[1].sum()), classes[0], classes[1]).start()


# training


def train_on(model: Model, weights: np.ndarray, squares: np.ndarray, texts: list[str | None]) -> int:
    """Updates the weights in place, in mini-batches; gives the number of tokens."""
    tokens, sizes = tokens_of(texts)
    classes = model.classes(tokens)
    rows = features(tokens, classes, firsts(sizes))
    for i in range(0, len(tokens), MINIBATCH):
        update(weights, squares, rows[:, :, i : i + MINIBATCH], classes[i : i + MINIBATCH])
    return len(tokens)


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, 0
        weights, squares = model.weights.copy(), np.zeros(ROWS, np.float32)
        for batch in batches:
            if len(batch):
                seen += train_on(model, weights, squares, batch.column("text").to_pylist())
        if seen:
            # a partition's change counts by its tokens
            change = np.array_split((weights - model.weights) * np.float32(seen), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(seen)] * BLOCKS, pa.float64()), pa.array([c.astype(np.float32).tobytes() for c in change], pa.binary())], names=["block", "n", "data"])

    return run


def _average(table: pa.Table) -> pa.Table:
    total, n = None, 0.0
    for data, m in zip(table.column("data"), table.column("n")):
        change = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
        total = change if total is None else total + change
        n += m.as_py()
    return pa.table({"block": table.column("block")[:1], "n": pa.array([n]), "data": pa.array([total.tobytes()], pa.binary())})


def _folded(changes: DataFrame, salts: int) -> DataFrame:
    """Sums of changes by block: first within salts, so that no task gets the changes of all partitions."""
    some = changes.withColumn("salt", F.expr(f"cast(spark_partition_id() % {salts} as int)"))

    def part(table: pa.Table) -> pa.Table:
        got = _average(table)
        narrow = pa.array([np.frombuffer(got.column("data")[0].as_buffer(), np.float64).astype(np.float32).tobytes()], pa.binary())
        return got.set_column(2, "data", narrow)

    return some.groupBy("block", "salt").applyInArrow(part, "block int, n double, data binary").groupBy("block").applyInArrow(_average, "block int, n double, data binary")


def fit(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Gradient updates over all training documents, a share of them in each round."""
    context = docs.sparkSession.sparkContext
    share = f"cast(crc32(coalesce(cast(`{id_col}` as string), '')) / 10 as long) % {rounds}"
    for r in range(rounds):
        shared = context.broadcast(model)
        rows = docs.where(f"not {held_out(id_col)} and {share} = {r}").select(F.col(text_col).alias("text"))
        changes = rows.mapInArrow(_train(shared), "block int, n double, data binary")
        blocks = {row["block"]: row for row in _folded(changes, 16).collect()}
        if blocks:
            change = np.concatenate([np.frombuffer(bytes(blocks[b]["data"]), np.float64) for b in range(BLOCKS)]) / blocks[0]["n"]
            model.weights = (model.weights + change.reshape(model.weights.shape)).astype(np.float32)
        shared.unpersist()
    return model


# scoring

SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Known:
    """What scoring needs of a group's different tokens, computed once for each: by the token's place."""

    def __init__(self, model: Model, keys: np.ndarray, counts: np.ndarray):
        self.places, self.counts, self.classes = Places(keys, _WIDTHS[0]), counts, model.classes(keys)
        self.base, self.share = model.base(counts), model.in_class(counts, self.classes)
        self.weight = np.log10(counts + PRIOR)


def score_batch(model: Model, tokens: np.ndarray, sizes: np.ndarray, known: Known, pair_places: Places, pair_counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of each text; `known` and the pairs hold all of the texts' own."""
    first, starts = firsts(sizes), np.cumsum(sizes) - sizes
    at = known.places.of(tokens)
    before = np.roll(at, 1)
    before[first] = at[sizes[0] - 1]  # the end, which ends every text
    classes = known.classes[at]
    rows = features(tokens, classes, first)
    own = np.empty(len(tokens))
    for i in range(0, len(tokens), MINIBATCH):
        own[i : i + MINIBATCH] = log_class(model.weights, rows[:, :, i : i + MINIBATCH], classes[i : i + MINIBATCH])
    own = np.exp(own) * known.share[at]  # M(word | history)
    pairs = pair_counts[pair_places.of(pair_keys(before_each(tokens, first), tokens))]
    pairs = np.minimum(pairs, known.counts[before])
    score = np.log10(pairs + PRIOR * own) - known.weight[before]
    add = lambda x: np.add.reduceat(x, starts)
    return sizes, add((known.counts[at] > 0).astype(np.int64)), add(known.base[at]), add(score)


def _answered(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a group's tokens and pairs from its answers in the order of buckets, which are ranges of keys."""
    out = []
    for d in data:
        n, m = np.frombuffer(d, np.uint32, 2).tolist()
        out.append((of_planes(d, n, 5, 8).astype(np.int64), of_planes(d, m, 5, 8 + 5 * n).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def group_scores(model: Model, texts: list[list[str | None]], answers: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """`score_batch` of each batch of a group's texts.  Answers name no keys: the group has the same ones again."""
    coded = [tokens_of(t) for t in texts]
    both = [(tokens, pair_keys(before_each(tokens, firsts(sizes)), tokens)) for tokens, sizes in coded]
    keys = [np.unique(np.concatenate(x)) for x in zip(*both)]
    del both
    counts = _answered(answers)
    if any(len(k) != len(n) for k, n in zip(keys, counts)):
        raise ValueError("a group's documents have changed since they were counted")
    known, pair_places = Known(model, keys[0], counts[0]), Places(keys[1], _WIDTHS[1])
    for tokens, sizes in coded:
        yield score_batch(model, tokens, sizes, known, pair_places, counts[1])


def _score(shared):
    """Rows of a group: first the counts of its tokens and pairs by bucket (kind 0), then its documents (kind 1)."""

    def scored(answers: list[bytes], docs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, scores in zip(docs, group_scores(model, [d.column("text").to_pylist() for d in docs], answers)):
            arrays = [pa.array(x) for x in (*scores[:2], np.full(len(part), model.total), *scores[2:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *arrays], names=[f.split()[0] for f in SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, docs = None, [], []
        for g, part in _by_group(batches):
            if g != now:
                if docs:
                    yield from scored(answers, docs)
                now, answers, docs = g, [], []
            n = int((part.column("kind").to_numpy(zero_copy_only=False) == 0).sum())
            answers += part.column("data").to_pylist()[:n]
            if n < len(part):
                docs.append(part.slice(n))
        if docs:
            yield from scored(answers, docs)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Counts, trains and scores: (id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shares(docs, GROUP_BYTES)
    groups = 2 * parts
    rows = docs.select(
        F.expr(f"cast(pmod(xxhash64(`{id_col}`, length(`{text_col}`)), {groups}) as int)").alias("g"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.expr(held_out(id_col)).alias("held_out"),
    )
    sent = rows.select("g", "text", "held_out").repartitionById(parts, "g").sortWithinPartitions("g").mapInArrow(_send_counts(parts), "bucket int, g int, data binary")
    path = scratch(spark, "lm-counts")
    with shuffles_freed(spark):
        sent.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_add_up, ROW).write.option("compression", "zstd").parquet(path)
    counted = spark.read.schema(ROW).parquet(path)
    model = _model(counted.where("kind = 2").select("data").toLocalIterator())
    model = fit(docs, model, id_col, text_col, rounds)
    shared = spark.sparkContext.broadcast(model)
    whole = rows.selectExpr("g", "1 as kind", "id", "text", "cast(null as int) as bucket", "cast(null as binary) as data", "held_out")
    both = counted.where("kind = 0").withColumn("held_out", F.lit(None).cast("boolean")).unionByName(whole)
    out = both.repartitionById(parts, "g").sortWithinPartitions("g", "kind", "bucket").mapInArrow(_score(shared), SCORES)
    return out.withColumnRenamed("id", id_col)
