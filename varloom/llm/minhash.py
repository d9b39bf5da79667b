"""Near-duplicate documents by b-bit MinHash: bands name candidates, packed low bits estimate them, full sets decide.

A document's set are its distinct word shingles, as 64-bit hashes made of the words' hashes.  Documents of one set are one
class.  A class has HASHES minima; bands of ROWS of them name the buckets in which it is found, and of each minimum two bits
are kept, packed in planes of 64-bit words.  Two classes' equal bits, counted by exclusive or, estimate their similarity:
of unequal minima a quarter agree by chance, which is taken off.  A pair is dropped only if a pair of the wanted similarity would
have so few equal bits once in 10^9 times; all others are decided on the full sets, made of the texts again.

All pairs of a bucket are never listed.  First each class is compared with one leader of each of its buckets, and the
best of these is decided; that is repeated with other leaders among classes that are not connected yet.  What remains are
classes outside the largest connected part of a bucket, and classes whose bits agree with theirs.  Of these the full sets are
laid out shingle by shingle, the rarest first: two sets of the wanted similarity have one of their first few in common (as many
as may be missing, and one).  Pairs that do are decided.  A class that is no copy has rare shingles enough of its own and meets
nothing, however many classes are nearly like it.

A link is lost only if all of BANDS bands miss it (7e-10 at a similarity of 0.85, less above) or by the estimate (1e-9).

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer than three words are one
shingle; equal texts are linked by their set; a null id is never the least unless all of a group's are null; repeated rows give
repeated rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.base import map_texts, shares, written
from varloom.llm.components import components

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 36, 5
HASHES = 256
SEED = 42
#: Chance with which the estimate may drop a link.
MISS = 1e-9
#: Rounds of leaders before pairs are listed.
ROUNDS = 2
#: Classes in question up to which their names are broadcast to the texts, some 5 MB; more meet them by a shuffle.
BROADCAST_CLASSES = 100_000
#: Shingles of the texts that one task compares, and of the members that share a copy of their leader.
TASK_SHINGLES = 4 << 20
MEMBER_SHINGLES = 1 << 20
#: Hashes that are multiplied at a time.
_CHUNK = 1 << 15
WORDS = HASHES // 64
SIGNATURE = [f"s{i}" for i in range(2 * WORDS)]


def _odd(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}".encode(), SEED) | 1 for i in range(n)], np.uint64)


_PLACE, _FACTOR, _BAND = _odd("place", SHINGLE + 1), _odd("factor", HASHES), _odd("band", HASHES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles (A-Z lower-cased)."""
    if not texts:
        return []
    data = b" \xff ".join(t.encode().lower() for t in texts) + b" \xff"
    coded = pa.array(data.split(), pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
    index = coded.indices.to_numpy()
    end = coded.dictionary.to_pylist().index(b"\xff")
    ends = np.flatnonzero(index == end)
    words = hashes[index]
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        sums += words[i : i + len(sums)] * _PLACE[i]
    grams, out = _mixed(sums), []
    for low, high in zip(starts, ends):
        if high - low >= size:
            out.append(np.unique(grams[low : high - size + 1]))
        else:  # the number of words is part of it
            whole = np.append(words[low:high] * _PLACE[: high - low], _PLACE[size : size + 1] * np.uint64(high - low)).sum(dtype=np.uint64, keepdims=True)
            out.append(_mixed(whole) if high > low else np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each of the sets, none of which is empty: one row for each hash."""
    out = np.empty((HASHES, len(sets)), np.uint64)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (n == 0 or n + len(sets[last]) <= _CHUNK):
            n += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *[len(s) for s in sets[first : last - 1]]])
        buffer = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _FACTOR[k], out=buffer)
            out[k, first:last] = np.minimum.reduceat(buffer, starts)
        first = last
    return out


def _packed(low: np.ndarray) -> list[np.ndarray]:
    """Planes of the two lower bits of (HASHES, n) numbers, as WORDS signed longs each."""
    out = []
    for bit in (0, 1):
        rows = np.packbits((low >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out += list(np.ascontiguousarray(rows.T).view("<i8").T)
    return out


def add_signatures(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds n_shingles, a 128-bit digest of the set (d1, d2), the packed bits and the bands' names."""

    def make() -> Callable:
        def work(texts: list[str]) -> dict:
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            signature = np.zeros((len(SIGNATURE), len(sets)), np.int64)
            bands: list = [[] for _ in sets]
            if full:
                m = minima([sets[i] for i in full])
                # the lowest bits of a product depend on the lowest bits of its factors alone: the bits above 16 are used
                signature[:, full] = _packed(m >> np.uint64(16))
                names = _mixed((m[: BANDS * ROWS] * _BAND[: BANDS * ROWS, None]).reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64) + _BAND[:BANDS, None])
                for i, own in zip(full, names.T.astype(np.int64)):
                    bands[i] = own
            out = {"n_shingles": [len(s) for s in sets], "d1": digests[:, 0].tolist(), "d2": digests[:, 1].tolist(), "bands": bands}
            return out | {name: row.tolist() for name, row in zip(SIGNATURE, signature)}

        return work

    schema = "n_shingles long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"
    return map_texts(docs, make, schema, text_col, drop_text)


def least_equal(percent: int = PERCENT, miss: float = MISS) -> int:
    """Equal minima (of HASHES, by their two bits) that a link has at least, but for a chance of `miss`."""
    p = percent / 100 + (1 - percent / 100) / 4
    below = 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > miss:
            return k
    return HASHES


def similarity(equal: float) -> float:
    """The estimate from equal bits, without those equal by chance."""
    return (equal / HASHES - 0.25) / 0.75


def _equal(a: str, b: str) -> str:
    """SQL: minima whose two bits agree."""
    return f"({HASHES} - " + " - ".join(f"bit_count(({a}.s{i} ^ {b}.s{i}) | ({a}.s{i + WORDS} ^ {b}.s{i + WORDS}))" for i in range(WORDS)) + ")"


def _likely(a: str, b: str, percent: int) -> str:
    """SQL: whether sizes and bits allow a link."""
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {_equal(a, b)} >= {least_equal(percent)}"


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n, text) of classes: each has the text of one of its documents."""
    needed = written(nodes.join(classes.select("node", "n", "row_name", "row_key"), "node"), "minhash-needed")
    if needed.count() <= BROADCAST_CLASSES:
        needed = F.broadcast(needed)
    return docs.join(needed, ["row_name", "row_key"]).select("node", "n", "text").dropDuplicates(["node"])


def decided(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (u, v) of classes, which are a written table, whose full sets are similar enough.

    Texts of the classes in question move once, and then once to each group of their leader u; a leader's members are
    divided among groups, so that no group and no task holds more than its number of shingles (or one pair).
    """
    spark = docs.sparkSession
    if pairs.isEmpty():
        return pairs
    texts = written(_texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), classes, docs), "minhash-texts")
    sizes = texts.select("node", "n")
    load = pairs.groupBy("u").agg(F.count("*").alias("members")).join(sizes.withColumnRenamed("node", "u"), "u")
    load = load.select("u", "n", F.expr(f"cast(ceil(members * n / {MEMBER_SHINGLES}) as long)").alias("parts"))
    dealt = written(pairs.join(load, "u").select("u", "v", "n", F.expr("pmod(xxhash64(v), parts)").alias("part")), "minhash-dealt")
    tasks = max(shares(dealt, 1 << 40), -(-2 * (dealt.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // TASK_SHINGLES))
    task = F.expr(f"cast(pmod(xxhash64(u, part), {tasks}) as int)").alias("task")
    members = dealt.join(texts.select(F.col("node").alias("v"), "text"), "v").select(task, "u", "v", "text")
    leaders = dealt.select("u", task).distinct().join(texts.select(F.col("node").alias("u"), "text"), "u").select("task", "u", F.lit(None).cast("long").alias("v"), "text")

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets([x or "" for x in table.column("text").to_pylist()])
        u, v = table.column("u").to_pylist(), table.column("v").to_pylist()
        of = {x: s for x, y, s in zip(u, v, sets) if y is None}
        found = []
        for x, y, s in zip(u, v, sets):
            if y is not None:
                both = len(np.intersect1d(of[x], s, assume_unique=True))
                if 100 * both >= percent * (len(of[x]) + len(s) - both):
                    found.append((x, y))
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return members.unionByName(leaders).groupBy("task").applyInArrow(run, "u long, v long")


def _state(classes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Adds comp, the least class that links lead to."""
    if edges is None:
        return classes.withColumn("comp", F.col("node"))
    return classes.join(components(edges, "minhash-components"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Without pairs that were decided before, in whichever order."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")


def _to_leaders(filed: DataFrame, state: DataFrame, turn: int, tried: DataFrame | None, percent: int) -> DataFrame:
    """(u, v): of each class the likeliest of its buckets' leaders that it is not connected with."""
    leaders = written(filed.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket", F.lit(turn))).alias("leader")), "minhash-leaders")
    pairs = filed.join(leaders, "bucket").where("node <> leader").select("node", "leader").distinct()
    if tried is not None:
        both = tried.unionByName(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = pairs.join(both.select(F.col("u").alias("leader"), F.col("v").alias("node")), ["leader", "node"], "left_anti")
    row = F.struct("n", "comp", *SIGNATURE)
    pairs = pairs.join(state.select("node", row.alias("a")), "node").join(state.select(F.col("node").alias("leader"), row.alias("b")), "leader")
    likely = pairs.where(f"a.comp <> b.comp and {_likely('a', 'b', percent)}")
    best = likely.groupBy(F.col("node").alias("v")).agg(F.max_by("leader", F.expr(_equal("a", "b"))).alias("u"))
    return best.select("u", "v")


def _open(filed: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """(node, outside): classes outside the largest connected part of a bucket that some class of it, not connected with them,
    may link with, and these other classes."""
    rows = filed.join(state.select("node", "n", "comp", *SIGNATURE), "node")
    parts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("comp", "m").alias("largest")).where("parts > 1").select("bucket", "largest")
    rows = written(rows.join(open_, "bucket"), "minhash-open")
    pack = F.struct("node", "n", "comp", *SIGNATURE)
    left, right = rows.where("comp <> largest").select("bucket", pack.alias("a")), rows.select(F.col("bucket").alias("b_bucket"), pack.alias("b"))
    on = F.expr(f"bucket = b_bucket and a.comp <> b.comp and {_likely('a', 'b', percent)}")
    nodes = left.join(right, on, "left_semi").select("a.node", F.lit(True).alias("outside")).unionByName(right.join(left, on, "left_semi").select("b.node", F.lit(False).alias("outside")))
    return nodes.groupBy("node").agg(F.bool_or("outside").alias("outside"))


def _across(nodes: DataFrame, state: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of the open classes that are not connected and may be similar enough by their rarest shingles."""
    texts = _texts(nodes.select("node"), classes, docs)

    def make() -> Callable:
        return lambda texts: {"shingles": [s.astype(np.int64) for s in shingle_sets(texts)]}

    rows = written(map_texts(texts, make, "shingles array<long>", "text", True).select("node", "n", F.explode("shingles").alias("shingle")), "minhash-shingles")
    # one that no other has is never in common, but is among the first
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(shared, "shingle").withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")))
    many = ranked.groupBy("node").agg(F.count("*").alias("many"))
    first = ranked.join(many, "node").where(f"n - many + nth <= n - ceil({percent} * n / 100) + 1").select("node", "shingle", (F.col("n") - F.col("many") + F.col("nth")).alias("at"))
    row = F.struct("node", "n", "comp", "at", *SIGNATURE)
    first = written(first.join(state.drop("at"), "node").join(nodes, "node").select("shingle", "outside", row.alias("a")), "minhash-first")
    other = first.select(F.col("shingle").alias("b_shingle"), F.col("a").alias("b"))
    # after the first that both have, at most what is left of either can be in common
    enough = f"(1 + least(a.n - a.at, b.n - b.at)) * {100 + percent} >= {percent} * (a.n + b.n)"
    on = F.expr(f"shingle = b_shingle and a.comp <> b.comp and {enough} and {_likely('a', 'b', percent)}")
    return first.where("outside").join(other, on).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("row_name"), F.xxhash64(text).alias("row_key"))
    marked = written(add_signatures(rows, drop_text=True), "minhash-docs")
    pick = F.first(F.struct(F.col("n_shingles").alias("n"), "row_name", "row_key", "bands", *SIGNATURE))
    classes = marked.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("least"), pick.alias("p"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "least", "p.*"), "minhash-classes")
    filed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    filed = written(filed.join(shared, "bucket"), "minhash-buckets")

    state, edges, tried = _state(classes.drop("bands"), None), None, None
    source = rows.select("row_name", "row_key", "text")
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            found = _to_leaders(filed, state, turn, tried, percent)
        else:
            open_ = written(_open(filed, state, percent), "minhash-outside")
            if open_.isEmpty():
                break
            found = _untried(_across(open_, state, classes, source, percent), tried)
        pairs = written(found, "minhash-pairs")
        tried = _untried(pairs, None) if tried is None else tried.unionByName(_untried(pairs, None))
        new = written(decided(pairs, classes, source, percent), "minhash-links")
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            state = written(_state(classes.drop("bands"), edges), "minhash-state")

    least = state.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = state.join(least, "comp").select("d1", "d2", "component_id")
    out = marked.select("id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    # a document without shingles is alone
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
