"""Near-duplicates, components, repeated substrings and language-model scores against brute force."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from varloom.llm import lm, simhash, substrings
from varloom.llm.base import shares, text_shares
from varloom.llm.components import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def close(values, radius=2):
    a = np.array(sorted(values), np.uint64)
    return [(int(a[i]), int(y)) for i in range(len(a)) for y in a[i + 1 :][np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius]]


@pytest.mark.parametrize("n, file_rows", [(400, simhash.FILE_ROWS), (400, 2), (400, 0)])
def test_links_lose_no_pair(spark, monkeypatch, n, file_rows):
    monkeypatch.setattr(simhash, "FILE_ROWS", file_rows)
    r = random.Random(n)
    values = {0, 1, 3, 2**64 - 1}
    while len(values) < n:
        x = r.choice(sorted(values)) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    signed = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = {frozenset(int(np.int64(x).astype(np.uint64)) for x in row) for row in simhash.links(signed).collect()}
    assert got == {frozenset(p) for p in close(values)}


def test_pivots_discard_nearly_all_pairs_of_documents(spark):
    """The figures in the README, on sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    prints = simhash.add_fingerprints(docs, drop_text=True).distinct()
    row = simhash.pair_counts(prints).first()
    print(prints.count(), row)
    assert row["seen"] > 10 * row["left"] and row["left"] >= row["verified"] > 0


def test_components(spark):
    r = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(60)], []):
        got = {row["node"]: row["component"] for row in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert got == groups(nodes, [e for e in edges if e[0] != e[1]])


def near_copies(seed, n=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            t = r.choice(out).split(" ")
            if t and r.random() < 0.7:
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 2, 5, 400]))]
        out.append(" ".join(t))
    return out


def test_near_duplicates(spark):
    texts = [None, "", " \t", "A b", "a B", "a  b\n"] + near_copies(4)
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(500, "A b"), (500, "A b")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    top = groups(set(prints), close(set(prints)))
    least = {}
    for (i, _), p in zip(rows, prints):
        least[top[p]] = min(i, least.get(top[p], i))
    want = sorted((i, f"{p:016x}", least[top[p]]) for (i, _), p in zip(rows, prints))
    assert sorted(map(tuple, got)) == want
    assert len(set(top.values())) < len(set(prints))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA + ", fp string, component_id int, least int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_null_ids_of_near_duplicates(spark):
    rows = [(None, "only nulls here in this group"), (None, "only nulls here in this group"), (None, "a text that has an id elsewhere"), (4, "a text that has an id elsewhere")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == ["4", "4", "None", "None"]
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == [(4, rows[3][1]), (None, rows[0][1])]


def plain_removed(rows, length=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(t), bytes(b for b, g in zip(t, gone) if not g), sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))))
    return sorted(out)


@pytest.mark.parametrize("length, hot", [(50, substrings.HOT), (50, 0), (7, substrings.HOT), (7, 1)])
def test_substrings(spark, length, hot):
    r = random.Random(length + hot)
    pool = ["".join(r.choice("abcé \x00") for _ in range(r.choice([5, 30, 90, 200]))) for _ in range(12)] + ["a" * 300, "ab" * 120]
    texts = ["", None, "short"] + ["".join(r.choice(pool) for _ in range(r.randint(0, 5))) for _ in range(60)]
    rows = [(i * 13 % 64, t) for i, t in enumerate(texts)] + [(70, texts[5]), (70, texts[5]), (71, texts[5])]
    docs = spark.createDataFrame([(*row, 1, b"x") for row in rows], SCHEMA + ", n_bytes int, kept binary")
    got = substrings.remove_repeats(docs, length=length, hot=hot).collect()
    want = plain_removed([(i, (t or "").encode()) for i, t in rows], length)
    assert sorted((x["doc_id"], x["n_bytes"], bytes(x["kept"]), len(x["spans"])) for x in got) == want
    for x in got:
        text = dict(rows)[x["doc_id"]] or ""
        at, left = 0, b""
        for s in x["spans"]:
            left += text.encode()[at : s["start"]]
            at = s["end"]
        assert left + text.encode()[at:] == bytes(x["kept"])


def test_substrings_of_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "x" * 60), (3, "x" * 60), (None, "y" * 60), (None, "y" * 60)], SCHEMA)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in substrings.remove_repeats(docs).collect())
    assert got == [("3", b"x" * 60), ("None", b""), ("None", b"y" * 60), ("None", b"y" * 60)]


def test_intervals_are_those_of_sorted_suffixes():
    r = random.Random(2)
    for n in (1, 2, 30, 500):
        x = np.array([r.choice([97, 98, 0]) for _ in range(n)], np.uint8)
        for depth in (1, 3, 9, 50):
            order = substrings.suffix_order(x, depth)
            padded = [bytes(x[i : i + depth]).ljust(depth, b"\0") for i in range(n)]
            assert [padded[i] for i in order] == sorted(padded)
            apart = substrings.expand_intervals(x, order, depth)
            for q in range(1, n):
                i, j = int(order[q - 1]), int(order[q])
                if max(i, j) + depth <= n:
                    assert apart[q] == (padded[i] != padded[j])


def test_language_model(spark):
    r = random.Random(9)
    grammar = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["down", "the"], "ran": ["off", "the"], "down": ["the"], "off": ["the"]}

    def sentence():
        out = ["the"]
        for _ in range(r.randint(5, 60)):
            out.append(r.choice(grammar[out[-1]]) if r.random() < 0.95 else f"Rare{r.randrange(500)},")
            if out[-1] not in grammar:
                out.append("the")
        return " ".join(out)

    rows = [(i, sentence()) for i in range(1500)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "never seen words"), (2004, "the " * 5000), (7, "the cat"), (None, "the dog")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], SCHEMA + ", score double")
    got = lm.score_texts(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
    want = sorted(((str(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n) for i, t in rows))
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) for x in got) == want
    text = {i: t for i, t in rows if i != 7}
    for x in got:
        if x["doc_id"] != 7:
            assert x["base_score"] == pytest.approx(base(text[x["doc_id"]]), rel=1e-9)
        assert math.isfinite(x["score"]) and x["score"] < 0
    out = [x for x in got if x["held_out"] and x["doc_id"] not in (None, 2004)]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out) * 0.85
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    w = r.normal(size=(lm.ROWS, lm.WIDE)).astype(np.float32)
    tokens, classes = r.integers(1, 99, 50).astype(np.uint64), r.integers(0, lm.CLASSES, 50)
    first = np.arange(50) % 10 == 0
    rows = lm.features(tokens, classes, first)
    for level in rows:
        assert np.allclose(np.exp(lm.log_softmax(w, level)).sum(axis=0), 1, atol=1e-4)
    # over all classes of one token, whose history stays the same
    every = [lm.log_class(w, lm.features(tokens, np.where(np.arange(50) == 49, k, classes), first), np.where(np.arange(50) == 49, k, classes))[49] for k in range(lm.CLASSES)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    before = lm.log_class(w, rows, classes).sum()
    lm.update(w, np.zeros(lm.ROWS, np.float32), rows, classes)
    assert lm.log_class(w, rows, classes).sum() > before


MASK, MULTIPLIER = 2**64 - 1, 0x9E3779B97F4A7C15


def plain_mix(k):
    k = (k ^ k >> 31) * MULTIPLIER & MASK
    k = (k ^ k >> 29) * 0xBF58476D1CE4E5B9 & MASK
    return k ^ k >> 32


def plain_key(word):
    h = plain_mix(sum(plain_mix((b + 1) * MULTIPLIER & MASK) * pow(lm._BASE, i, 2**64) for i, b in enumerate(word)) + len(word) & MASK)
    tail = word[-3:].rstrip(b".,;:!?")
    return h & ~127 | plain_mix(int.from_bytes(tail, "big") + MULTIPLIER & MASK) & 127


def plain_tokens(text):
    return [plain_key(w) for w in (text or "").encode().lower().split()] + [int(lm.END)]


def test_keys_of_words(monkeypatch):
    r = random.Random(8)
    texts = [None, "", "a", " \x0b\x0c x.,!  é\n", "Z" * 900, "ab, ...", ";;;;"] + ["".join(r.choice("abCD é.,\n\t") for _ in range(r.randint(0, 90))) for _ in range(80)]
    for chunk in (lm.CHUNK_BYTES, 7):
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        keys, sizes = lm.tokens_of(texts)
        assert sizes.tolist() == [len(plain_tokens(t)) for t in texts] and keys.tolist() == [k for t in texts for k in plain_tokens(t)]
    keys, sizes = lm.tokens_of([])
    assert len(keys) == len(sizes) == 0


def plain_scores(rows, minibatch):
    """The whole model in loops over tokens, one partition: counts, training, scores."""
    number = lambda i: zlib.crc32(str(i).encode())
    train = [(i, plain_tokens(t)) for i, t in rows if number(i) % 10]
    c = Counter(k for _, t in train for k in t)
    pairs = Counter(p for _, t in train for p in zip([int(lm.END), *t], t))
    top = sorted(c, key=lambda k: (-c[k], k))[: lm.TOP]
    own = {k: i for i, k in enumerate(top)}
    class_of = lambda k: own.get(k, lm.TOP + (k & 127))
    total, distinct = [0] * lm.CLASSES, [0] * lm.CLASSES
    for k, n in c.items():
        total[class_of(k)] += n
        distinct[class_of(k)] += 1
    share = [n + 0.1 * (v + 1) for n, v in zip(total, distinct)]
    w = {}
    for a in range(16):
        part = share[16 * a : 16 * a + 16]
        w.setdefault(lm.FEATURES, []).append(math.log(sum(part) / sum(share)))
        w[lm.FEATURES + 1 + a] = [math.log(x / sum(part)) for x in part]

    def rows_of(t, i):
        one, two = (t[i - 1] if i >= 1 else 0), (t[i - 2] if i >= 2 else 0)
        c1, c2 = (class_of(one) + 1 if i >= 1 else 0), (class_of(two) + 1 if i >= 2 else 0)
        part = class_of(t[i]) // 16
        keys = [one * MULTIPLIER + 1, two * MULTIPLIER + 2, ((one * MULTIPLIER + two) & MASK) * MULTIPLIER + 3, (c1 * 997 + c2) * MULTIPLIER + 4]
        keys = [(k & MASK) ^ (k & MASK) >> 31 for k in keys]
        up = lambda k: (k * MULTIPLIER & MASK) >> 49
        return [[up(k) for k in keys] + [lm.FEATURES], [up(k + (part + 1) * 0xD6E8FEB86659FD93 & MASK) for k in keys] + [lm.FEATURES + 1 + part]]

    def probabilities(some):
        z = [sum(w.setdefault(r, [0.0] * 16)[j] for r in some) for j in range(16)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    for share_of in range(lm.ROUNDS):
        tokens = [(t, i) for d, t in train if number(d) // 10 % lm.ROUNDS == share_of for i in range(len(t))]
        squares = Counter()
        for at in range(0, len(tokens), minibatch):
            change = {}
            for t, i in tokens[at : at + minibatch]:
                k = class_of(t[i])
                for some, right in zip(rows_of(t, i), (k // 16, k % 16)):
                    error = probabilities(some)
                    error[right] -= 1
                    for r in some:
                        change[r] = [x + y for x, y in zip(change.get(r, [0.0] * 16), error)]
            for r, x in change.items():
                squares[r] += sum(y * y for y in x) / 16
                w[r] = [a - lm.RATE / math.sqrt(1 + squares[r]) * y for a, y in zip(w[r], x)]
    out = []
    for d, text in rows:
        t, score = plain_tokens(text), 0.0
        for i, k in enumerate(t):
            a, b = rows_of(t, i)
            q = class_of(k)
            m = probabilities(a)[q // 16] * probabilities(b)[q % 16]
            if k not in own:
                m *= (c[k] + 0.1) / (total[q] + 0.1 * (distinct[q] + 1))
            before = t[i - 1] if i else int(lm.END)
            score += math.log10((pairs[before, k] + lm.PRIOR * m) / (c[before] + lm.PRIOR))
        out.append((d, score))
    return out


def few_documents():
    r = random.Random(4)
    words = [f"w{i}{x}" for i in range(60) for x in ("ing", "ed.", "a")] + ["the", "of"] * 20
    return [(i, " ".join(r.choice(words[: 10 + 3 * i]) for _ in range(r.randint(0, 30)))) for i in range(70)] + [(200, None), (201, "unseen x y")]


def test_scores_are_those_of_plain_loops(spark):
    """The query's operator on documents of one partition."""
    rows = few_documents()
    got = {x["doc_id"]: x["score"] for x in lm.score_texts(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    want = dict(plain_scores(rows, lm.MINIBATCH))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-3) for i in want)


def test_mini_batches_are_those_of_plain_loops(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "MINIBATCH", 50)
    rows, seen = few_documents(), lm._Seen()
    number = lambda i: zlib.crc32(str(i).encode())
    seen.add([t for _, t in rows], np.array([number(i) % 10 == 0 for i, _ in rows]))
    sent = [(b, 0, data) for b, data in seen.packed(2)]
    out = list(lm._add_up(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sent)], names=["bucket", "g", "data"])])))
    of_kind = lambda k: [d for o in out for kind, d in zip(o.column("kind").to_pylist(), o.column("data").to_pylist()) if kind == k]
    model = lm._model([{"data": d} for d in of_kind(2)])
    for share in range(lm.ROUNDS):
        weights = model.weights.copy()
        lm.train_on(model, weights, np.zeros(lm.ROWS, np.float32), [t for i, t in rows if number(i) % 10 and number(i) // 10 % lm.ROUNDS == share])
        model.weights = weights
    (*_, got), = lm.group_scores(model, [[t for _, t in rows]], of_kind(0))
    assert got.tolist() == pytest.approx([s for _, s in plain_scores(rows, 50)], rel=1e-3)


def test_word_pairs_grow_with_the_text(spark):
    """Each of many rare words has its own successor, all of one class: only counts by history word tell them apart."""
    r = random.Random(3)
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    pairs = [(f"h{i}xyz", f"w{i}abc") for i in range(3000)]
    text = lambda some: " ".join(x for p in some for x in p)
    train = [(i, text(r.sample(pairs, 100))) for i in range(4000) if zlib.crc32(str(i).encode()) % 10][:1500]
    right, wrong = [], []
    for i in held:
        some = r.sample(pairs, 50)
        (right if i < held[20] else wrong).append((i, text(some if i < held[20] else [(a, b) for (a, _), (_, b) in zip(some, some[1:] + some[:1])])))
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm.score_texts(spark.createDataFrame(train + right + wrong, SCHEMA)).collect()}
    mean = lambda rows: sum(got[i] for i, _ in rows) / len(rows)
    assert mean(right) > mean(wrong) + 0.5


def test_held_out_documents_of_the_shared_tables(spark, capsys):
    """The figures in the README, on sf0.01: log10 per token of held-out documents, by base and by model."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lm.score_texts(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) as model", "sum(base_score) / sum(n_tokens) as base").first()
    with capsys.disabled():
        print(f"held out: base {held['base']:.3f}, model {held['model']:.3f}")
    assert held["model"] > held["base"] + 0.3


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_counts_of_groups(monkeypatch, chunk):
    import pyarrow as pa

    monkeypatch.setattr(lm, "COUNT_TOKENS", chunk)
    texts = {0: [("a b a b", False), ("b c", True)], 1: [("A b", False), (None, False)]}
    tokens, pairs, sent = Counter(), Counter(), {}
    for g, rows in texts.items():
        seen = lm._Seen()
        seen.add([t for t, _ in rows], np.array([out for _, out in rows]))
        for t, out in rows:
            w = [int(lm.END), *plain_tokens(t)]
            for p in zip(w, w[1:]):
                tokens[p[1]] += not out
                pairs[p] += not out
        for b, data in seen.packed(3):
            sent.setdefault(b, []).append((g, data))
    rows = [(b, g, data) for b in sorted(sent) for g, data in sent[b]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "g", "data"])
    answers = {}
    for out in lm._add_up(iter([batch])):
        for kind, g, data in zip(*[out.column(c).to_pylist() for c in ("kind", "g", "data")]):
            if kind == 0:
                answers.setdefault(g, []).append(data)
    key = lambda p: int(lm.pair_keys(*(np.array([x], np.uint64) for x in p))[0])
    by_key = {key(p): c for p, c in pairs.items()}
    for g, rows in texts.items():
        own = [[int(lm.END), *plain_tokens(t)] for t, _ in rows]
        of_tokens, of_pairs = lm._answered(answers[g])
        assert of_tokens.tolist() == [tokens[k] for k in sorted({k for w in own for k in w[1:]})]
        assert of_pairs.tolist() == [by_key[k] for k in sorted({key(p) for w in own for p in zip(w, w[1:])})]


def test_shares_count_true_bytes(spark, tmp_path):
    """Texts that compress to nearly nothing still get as many shares as their bytes need."""
    docs = spark.createDataFrame([(i, "é" * 100_000) for i in range(50)] + [(99, None)], SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert text_shares(docs, "text", 1_000_000) == 10 > shares(docs, 1_000_000)
    assert text_shares(docs.limit(0), "text", 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
