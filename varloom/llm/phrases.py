"""Phrases of two to four words that stand together more often than their parts would, by pattern growth.

Texts become blocks: each holds a part of one language's words as numbers of its own, with a dictionary of these.  The
dictionaries are summed to the counts of all words; the frequent ones get numbers of the whole corpus, which go back to
each block through a join, so that no dictionary but a block's own is ever in one place.

A prefix's projection is the list of its occurrences, each with the up to three words that may follow it in its piece: a
block sorts and counts them before they travel.  Prefixes are dealt to tasks, each complete in one task, and there grown to
the right, depth first: all occurrences of a prefix are a range of the sorted list, and each further word that is frequent
in it narrows the range.  A prefix of more than SPLIT occurrences is not projected as a whole but by its next word, if need
be by the two or three next; its own count, and those of such prefixes on the way, are sums over all blocks.  As many
prefixes as divide the words of the corpus by SPLIT can be so frequent, at most MOST_HOT of each length: these lists are sent
to every task.

Counts are exact: words are compared as bytes and numbered, not hashed.

Defined results: a null text is empty; a null language is `und`; repeated rows count as often as they occur; windows never
cross a piece's end or a text's; ties of the score go by occurrences, then by the phrase's bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.base import bounded_batches, of_planes, planes, written

#: Ends of pieces, and what stands between words.
ENDS, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A candidate goes if a longer one holds it and occurs at least so many times in a hundred.
COVERED = 80
NO_LANG = "und"

#: Words in a block, and bytes of text that become words at a time.
BLOCK_WORDS = 8 << 20
CHUNK = 4 << 20
#: Words of a block whose occurrences are sorted and counted together.
SLICE = 1 << 20
#: Occurrences of a prefix beyond which its next word divides it, of a task's prefixes together, and prefixes of one length
#: that may be divided.
SPLIT = 500_000
TASK_WORDS = 1_000_000
MOST_HOT = 4_000_000

#: 0xFF is no byte of any text: it marks an end.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS + BETWEEN, bytes(range(97, 123)) + b"\xff" * len(ENDS) + b" " * len(BETWEEN))
BLOCK = "block long, lang string, words array<string>, counts array<long>, ids binary"
KEYS = ["w1", "w2", "w3", "w4"]


class _Block:
    """Words of one language as numbers in order of first appearance; 0 is an end."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"\xff": 0}
        self.ids: list[np.ndarray] = []

    def add(self, texts: list[str]) -> int:
        data = ("\n".join(texts) + "\n").encode().translate(_TABLE).replace(b"\xff", b" \xff ")
        at, n = 0, 0
        while at < len(data):
            end = data.rfind(b" ", at + 1, at + CHUNK) if at + CHUNK < len(data) else len(data)
            if end < 0:
                end = data.find(b" ", at + CHUNK)
            coded = pa.array(data[at:end].split(), pa.binary()).dictionary_encode()
            number = np.array([self.number.setdefault(w, len(self.number)) for w in coded.dictionary.to_pylist()], np.int32)
            if len(coded):
                self.ids.append(number[coded.indices.to_numpy()])
            n += len(coded)
            at = end
        return n

    def row(self) -> tuple:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        counts = np.bincount(ids, minlength=len(self.number))[1:]
        return pa.array(list(self.number)[1:], pa.binary()).cast(pa.string()), counts, planes(ids, 4)


def blocks_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Blocks of all words: see BLOCK.  Counts are of the block; ids are 4 planes of bytes."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, first = 0, TaskContext.get().partitionId() << 32
        open_, words = {}, 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, block in open_.items():
                names, counts, ids = block.row()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in (names, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([lang]), *lists, pa.array([ids], pa.binary())], names=["block", "lang", "words", "counts", "ids"])
                made += 1

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                words += open_.setdefault(lang, _Block()).add(own)
            if words >= BLOCK_WORDS:
                yield from closed()
                open_, words = {}, 0
        yield from closed()

    return source.mapInArrow(run, BLOCK)


def vocabulary(entries: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, n): words of at least `least` occurrences, numbered from 1 without gaps over all languages."""
    spark = entries.sparkSession
    kept = entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    # a row's number within its partition is the lower 33 bits
    rows = written(kept.select("lang", "word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "phrases-words")
    before, offsets = 1, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):  # one row for each partition
        offsets.append((part, before))
        before += n
    if before > 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return rows.join(starts, "part").select((F.col("nth") + F.col("before")).alias("id"), "lang", "word", "n")


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _unpacked(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)


def counted(k1: np.ndarray, k2: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, equal ones as one with the sum of their numbers."""
    order = np.lexsort((k2, k1))
    k1, k2, m = k1[order], k2[order], m[order]
    if len(k1):
        starts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        k1, k2, m = k1[starts], k2[starts], np.add.reduceat(m, starts)
    return k1, k2, m


def projected(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of all prefixes that a frequent word follows: (first, second), (third, fourth) words, and how many.

    The last MOST_WORDS - 1 numbers begin no prefix: they are those after the slice, or zeros.
    """
    n = len(ids) - MOST_WORDS + 1
    a, b, c, d = (ids[i : n + i] for i in range(MOST_WORDS))
    at = np.flatnonzero((a > 0) & (b > 0))
    k1, k2 = packed(a[at], b[at]), packed(c[at], np.where(c[at] > 0, d[at], 0))
    del a, b, c, d
    return counted(k1, k2, np.ones(len(at), np.int64))


def to_blob(k1: np.ndarray, k2: np.ndarray, m: np.ndarray) -> bytes:
    return pa.compress(planes(k1, 8) + planes(k2, 8) + planes(m, 8), "zstd", asbytes=True)


def of_blob(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data, 24 * n, "zstd", asbytes=True)
    return of_planes(raw, n, 8, 0), of_planes(raw, n, 8, 8 * n), of_planes(raw, n, 8, 16 * n).astype(np.int64)


def projections(blocks: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """(n, data): the sorted and counted occurrences of each slice of a block."""
    known = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("nth", "id")).alias("k"))
    rows = blocks.select("block", "ids").join(known, "block").select("ids", F.col("k.nth").alias("nth"), F.col("k.id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("ids")[i].as_py()
                local = of_planes(data, len(data) // 4, 4, 0).astype(np.int32)
                number = np.zeros(local.max(initial=0) + 1, np.uint32)
                number[batch.column("nth")[i].values.to_numpy()] = batch.column("id")[i].values.to_numpy()
                ids = np.concatenate([number[local], np.zeros(MOST_WORDS - 1, np.uint32)])
                del data, local
                for at in range(0, len(ids) - MOST_WORDS + 1, SLICE):
                    k1, k2, m = projected(ids[at : at + SLICE + MOST_WORDS - 1])
                    if len(m):
                        yield pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([to_blob(k1, k2, m)], pa.binary())], names=["n", "data"])

    return rows.mapInArrow(run, "n long, data binary")


def _within(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.searchsorted(values, x).clip(max=len(values) - 1)] == x


def _hot_triples(k1: np.ndarray, c: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Which rows' first three words are in the sorted structured array of (pair, third word)."""
    if not len(triples):
        return np.zeros(len(k1), bool)
    x = np.empty(len(k1), triples.dtype)
    x["pair"], x["third"] = k1, c
    return np.isin(x, triples)


TRIPLE = np.dtype([("pair", np.uint64), ("third", np.uint64)])


def frequent_prefixes(rows: DataFrame, single: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and triples of words of more than `split` occurrences, sorted, with their counts.

    All parts of such a phrase are as frequent, so a block only reports those whose words, and then pairs, are.
    """
    spark = rows.sparkSession
    pairs, triples = np.empty(0, np.uint64), np.empty(0, TRIPLE)
    none = np.empty(0, np.int64)
    if not len(single):
        return pairs, none, triples, none
    sent = spark.sparkContext.broadcast(single.astype(np.uint64))

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
                k1, _, m = of_blob(data, n)
                a, b = _unpacked(k1)
                at = np.flatnonzero(_within(a.astype(np.uint64), sent.value) & _within(b.astype(np.uint64), sent.value))
                k, _, m = counted(k1[at], np.zeros(len(at), np.uint64), m[at])
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(m)], names=["k", "m"])

    found = rows.mapInArrow(two, "k long, m long").groupBy("k").agg(F.sum("m").alias("m")).where(f"m > {split}").orderBy("k").collect()
    pairs, of_pairs = np.array([r["k"] for r in found], np.int64).astype(np.uint64), np.array([r["m"] for r in found], np.int64)
    if not len(pairs):
        return pairs, of_pairs, triples, none
    sent_pairs = spark.sparkContext.broadcast(pairs)

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
                k1, k2, m = of_blob(data, n)
                c = k2 >> np.uint64(32)
                second = packed(k1 & np.uint64(0xFFFFFFFF), c)
                at = np.flatnonzero((c > 0) & _within(k1, sent_pairs.value) & _within(second, sent_pairs.value))
                k, t, m = counted(k1[at], c[at], m[at])
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(t.astype(np.int64)), pa.array(m)], names=["k", "t", "m"])

    found = rows.mapInArrow(three, "k long, t long, m long").groupBy("k", "t").agg(F.sum("m").alias("m")).where(f"m > {split}").orderBy("k", "t").collect()
    triples = np.array([(r["k"], r["t"]) for r in found], TRIPLE)
    return pairs, of_pairs, triples, np.array([r["m"] for r in found], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def dealt(rows: DataFrame, single: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tasks: int) -> DataFrame:
    """(task, n, data): occurrences by the task that holds all of their prefix, or of as much of it as is not too frequent."""
    sent = rows.sparkSession.sparkContext.broadcast((single.astype(np.uint64), pairs, triples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, three = sent.value
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
                k1, k2, m = of_blob(data, n)
                a, c = k1 >> np.uint64(32), k2 >> np.uint64(32)
                key = _mixed(a)
                for more, hot in ((k1, _within(a, one)), (c, _within(k1, two)), (k2, _hot_triples(k1, c, three))):
                    key = np.where(hot, _mixed(key ^ _mixed(more + np.uint64(1))), key)
                task = (key % np.uint64(tasks)).astype(np.int32)
                order = np.argsort(task, kind="stable")
                task = task[order]
                starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
                parts = [order[i:j] for i, j in zip(starts, [*starts[1:], n])]
                yield pa.RecordBatch.from_arrays([pa.array(task[starts]), pa.array([len(p) for p in parts], pa.int64()), pa.array([to_blob(k1[p], k2[p], m[p]) for p in parts], pa.binary())], names=["task", "n", "data"])

    return rows.mapInArrow(run, "task int, n long, data binary")


def grow(words: list[np.ndarray], m: np.ndarray, prefix: tuple, low: int, high: int, least: int, out: list[tuple]) -> None:
    """Append (phrase, occurrences) of each frequent longer phrase that begins with the prefix, depth first.

    The rows from `low` to `high`, in order, are all occurrences of the prefix; `words` has one column for each place.
    """
    column = words[len(prefix)][low:high]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    sums = np.add.reduceat(m[low:high], starts)
    ends = np.append(starts[1:], high - low)
    for i in np.flatnonzero((sums >= least) & (column[starts] > 0)):
        longer = (*prefix, int(column[starts[i]]))
        if len(longer) > 1:
            out.append((longer, int(sums[i])))
        if len(longer) < MOST_WORDS:
            grow(words, m, longer, low + int(starts[i]), low + int(ends[i]), least, out)


def frequent_phrases(rows: DataFrame, single: np.ndarray, tasks: int, split: int, least: int) -> DataFrame:
    """(w1, w2, w3, w4, n): phrases of two words or more, by the numbers of their words and 0, and their occurrences."""
    pairs, of_pairs, triples, of_triples = frequent_prefixes(rows, single, split)
    sent = rows.sparkSession.sparkContext.broadcast((set(pairs.tolist()), set(triples.tolist())))

    def run(table: pa.Table) -> pa.Table:
        parts = [of_blob(d, n) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist())]
        k1, k2, m = counted(*(np.concatenate(x) for x in zip(*parts)))
        del parts
        words, out = [*_unpacked(k1), *_unpacked(k2)], []
        grow(words, m, (), 0, len(m), least, out)
        two, three = sent.value
        summed = lambda p: len(p) == 2 and (p[0] << 32 | p[1]) in two or len(p) == 3 and (p[0] << 32 | p[1], p[2]) in three
        out = [(*p, *[0] * (MOST_WORDS - len(p)), n) for p, n in out if not summed(p)]
        return pa.table({name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate([*KEYS, "n"])})

    grown = dealt(rows, single, pairs, triples, tasks).groupBy("task").applyInArrow(run, ", ".join(f"{k} long" for k in [*KEYS, "n"]))
    hot = [(*map(int, _unpacked(np.uint64(k))), 0, 0, int(n)) for k, n in zip(pairs, of_pairs)]
    hot += [(*map(int, _unpacked(k)), int(t), 0, int(n)) for (k, t), n in zip(triples, of_triples)]
    return grown.unionByName(rows.sparkSession.createDataFrame(hot, grown.schema)) if hot else grown


def _cut(k: int, n: int) -> str:
    """SQL: the two parts of a phrase of n words after its first k, each as three numbers."""
    parts = [[f"w{i + 1}" if i < k else "0L" for i in range(3)], [f"w{k + i + 1}" if k + i < n else "0L" for i in range(3)]]
    names = [f"{side}{i + 1}" for side in "lr" for i in range(3)]
    return f"named_struct('k', {k}, " + ", ".join(f"'{name}', {x}" for name, x in zip(names, parts[0] + parts[1])) + ")"


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds l, r and score of each phrase's weakest cut."""
    counts = phrases.where("w4 = 0").select("w1", "w2", "w3", "n").unionByName(words.select(F.col("id").alias("w1"), F.lit(0).cast("long").alias("w2"), F.lit(0).cast("long").alias("w3"), "n"))
    cuts = "case when w3 = 0 then array({}) when w4 = 0 then array({}) else array({}) end".format(*[", ".join(_cut(k, n) for k in range(1, n)) for n in (2, 3, 4)])
    rows = phrases.select(*KEYS, "n", F.explode(F.expr(cuts)).alias("c")).select(*KEYS, "n", "c.*")
    for side in "lr":
        part = counts.select(*[F.col(f"w{i}").alias(f"{side}{i}") for i in (1, 2, 3)], F.col("n").alias(side))
        rows = rows.join(part, [f"{side}{i}" for i in (1, 2, 3)])
    rows = rows.withColumn("score", F.expr("(cast(n as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)"))
    best = rows.groupBy(*KEYS, "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select(*KEYS, "n", "b.l", "b.r", "b.score")


def uncovered(rows: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without phrases that a longer one of nearly as many occurrences holds.

    It is enough to look at phrases of one word more: what lies between the two occurs at least as often as the longer.
    """
    longer = phrases.where("w3 > 0")
    first = longer.selectExpr("w1", "w2", "if(w4 > 0, w3, 0L) as w3", "n as above")
    last = longer.selectExpr("w2 as w1", "w3 as w2", "w4 as w3", "n as above")
    most = first.unionByName(last).groupBy("w1", "w2", "w3").agg(F.max("above").alias("above")).withColumn("w4", F.lit(0).cast("long"))
    held = F.expr(f"cast(above as decimal(20, 0)) * 100 >= cast(n as decimal(20, 0)) * {covered}")
    return rows.join(most, KEYS, "left").where(~F.coalesce(held, F.lit(False))).drop("above")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score."""
    blocks = written(blocks_of(docs, text_col, lang_col), "phrases-blocks")
    # an entry's number in its block is its place in the dictionary, from 1
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "lang", (F.col("at") + 1).alias("nth"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    words = written(vocabulary(entries, least), "phrases-vocabulary")
    totals = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    split = max(SPLIT, total // MOST_HOT)
    single = np.array(sorted(r["id"] for r in words.where(f"n > {split}").select("id").collect()), np.int64)  # at most MOST_HOT
    rows = written(projections(blocks, entries, words), "phrases-projections")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    phrases = written(frequent_phrases(rows, single, tasks, split, least), "phrases-frequent")

    found = uncovered(scored(phrases, words), phrases)
    texts = words.select("id", "lang", "word")
    found = found.join(texts.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    # of equal scores and counts all stay until their texts are known
    found = found.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n")))).where(f"rank <= {top}").drop("rank")
    for i in (2, 3, 4):
        found = found.join(texts.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    found = found.select("lang", F.concat_ws(" ", "t1", "t2", "t3", "t4").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
