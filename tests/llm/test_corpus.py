"""MinHash groups, divergence of sources and phrases against brute force, on small tables of hard documents."""
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import duckdb
import numpy as np
import pytest

from tests.llm.test_groups import groups, near_copies
from tests.llm.test_text_rules import TEXTS
from varloom.llm import divergence, minhash, phrases, registry
from varloom.llm.queries_divergence import OP12_SQL
from varloom.llm.queries_minhash import OP11_SQL
from varloom.llm.queries_phrases import OP13_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def plain_groups(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), groups(sorted(sets), links).values())} if list(sets) == sorted(sets) else None


def chain(seed, n, length=60, step=3):
    """Each text differs from the one before in a few words: neighbours link, ends do not."""
    r, words, out = random.Random(seed), None, []
    words = [f"c{seed}x{i}" for i in range(length)]
    for _ in range(n):
        for _ in range(step // 3):
            words[r.randrange(length)] = f"d{r.random()}"
        out.append(" ".join(words))
    return out


def hard_rows():
    r = random.Random(4)
    texts = [*TEXTS, *near_copies(5, 60), *near_copies(6, 60), *chain(1, 30), *chain(2, 12, 20), "a b", "A  b", "a", "a b c", "a\tb\nc", "", None, "   ", "ß b c d", "z" * 5000]
    base = [f"w{i}" for i in range(40)]
    for _ in range(80):  # copies of one text with few or many changes: some link with none of the others
        copy = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4, 8])):
            copy[r.randrange(40)] = f"v{r.randrange(60)}"
        texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rounds", [minhash.ROUNDS, 0])
def test_minhash_groups(spark, monkeypatch, rounds):
    """Also without rounds of leaders, when all links come from the rarest shingles."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rows = hard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    want = plain_groups(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) > 10 and sum(n == 1 for n in sizes.values()) > 20


def test_minhash_divides_members_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBER_SHINGLES", 50)
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 100)
    monkeypatch.setattr(minhash, "BROADCAST_CLASSES", 0)
    rows = hard_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_groups(rows)


def test_minhash_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, ""), (3, None), (3, "other words stand here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, node int")
    got = sorted(map(str, minhash.near_duplicates(docs).collect()))
    want = [(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, True), (3, 0, 3, True), (3, 2, 3, True)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c}, kept={d})" for a, b, c, d in want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_takes_chance_off(spark):
    """Sets of known similarity: the mean of estimates is near it, and no link falls below the least number of equal bits."""
    r = random.Random(9)
    for share in (0.5, 0.85, 0.95):
        seen = []
        for _ in range(60):
            n = 400
            both = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
            own = lambda: np.array([r.getrandbits(64) for _ in range(round(n * (1 - share) / share / 2))], np.uint64)
            m = minhash.minima([np.unique(np.concatenate([both, own()])) for _ in range(2)])
            bits = np.array(minhash._packed(m >> np.uint64(16)))
            differ = (bits[: minhash.WORDS, 0] ^ bits[: minhash.WORDS, 1]) | (bits[minhash.WORDS :, 0] ^ bits[minhash.WORDS :, 1])
            seen.append(minhash.HASHES - int(np.bitwise_count(differ.astype(np.uint64)).sum()))
        assert abs(minhash.similarity(np.mean(seen)) - share) < 0.02
        assert share < 0.85 or min(seen) >= minhash.least_equal()
    assert 180 < minhash.least_equal() < 205


def tables(spark, folder, rows):
    """The same documents for Spark and DuckDB, and none at all."""
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{folder}/{name}/documents.parquet")
    return folder


def sql_rows(folder, sql):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, sorted(map(str, found.fetchall()))


def test_minhash_query_gives_the_rows_of_its_sql(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, t, "en", None, None) for i, t in hard_rows()])
    columns, want = sql_rows(f"{folder}/some", OP11_SQL)
    op = registry.queries()["op11_minhash_dedup"]
    assert sorted(map(str, map(tuple, op(spark, f"{folder}/some").select(*columns).collect()))) == want
    assert op(spark, f"{folder}/none").count() == 0


def corpus(seed=3, n=400):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "ß", "x9y", "日本", "in", "of", "the", "co-op", "É", "é", "don't"]
    phrase = ["new york city hall", "as well as", "of the", "in spite of"]
    out = []
    for i in range(n):
        parts = [r.choice([*words, *phrase, r.choice(words).upper()]) + r.choice([" ", " ", " ", ", ", ". ", "\n", "\t", "\x01 ", "; "]) for _ in range(r.randint(0, 60))]
        out.append((i, "".join(parts) if r.random() > 0.03 else None, r.choice(["en", "en", "en", "de", None, ""]), r.choice(["a", "a", "a", "b", "c", None, "é"]), 1))
    return [*out, (n, "only here", "xx", "a", 1), (n + 1, None, "xx", "b", 1), (n + 2, "", "one", "a", None), out[0], out[0]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("corpus"), corpus())


@pytest.mark.parametrize("most", [divergence.BROADCAST_GROUPS, 0])
def test_divergence(spark, monkeypatch, folder, most):
    """Also when languages' rows are not broadcast."""
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", most)
    op = registry.queries()["op12_source_divergence"]
    columns, want = sql_rows(f"{folder}/some", OP12_SQL)
    got = op(spark, f"{folder}/some").select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == want and {r["part"] for r in got} == {"pair", "term"}
    assert {(r["source"], r["item"]): r["value"] for r in got if r["lang"] == "xx"} == {("a", "b"): 0, ("b", "a"): 0}
    assert op(spark, f"{folder}/none").count() == 0


def test_divergence_against_plain_loops(spark):
    rows = corpus(8, 150)
    import re

    docs, terms = [], lambda t: [x.translate(str.maketrans(divergence.UPPER, divergence.LOWER)) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    for _, t, lang, source, _ in rows:
        docs.append((lang or "", source or "", terms(t)))
    want = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(x for *_, w in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= 5)
        count = {s: Counter(x for _, q, w in own if q == s for x in w if df[x] >= 5) for s in {d[1] for d in own}}
        p = {s: {x: 1 + (10**9 * (c[x] + 5)) // (sum(c.values()) + 5 * len(kept)) for x in kept} for s, c in count.items()}
        for a in p:
            for b in p:
                if a != b:
                    want[lang, a, "pair", b] = sum(abs(p[a][x] - p[b][x]) for x in kept)
    got = {(r["lang"], r["source"], r["part"], r["item"]): r["value"] for r in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), 5).where("part = 'pair'").collect()}
    assert got == want


def test_shares_past_64_bits(spark):
    for count, total, v in ((0, 0, 1), (9_223_372_031, 10**13, 10**6), (9_223_372_032, 10**13, 10**6), (10**12, 3 * 10**13, 10**9)):
        got = spark.sql(f"select {divergence._share('c', 't')} as p from (select {count}L as c, {total}L as t, {v}L as v)").first()["p"]
        assert got == 1 + (10**9 * (count + 5)) // (total + 5 * v)


@pytest.mark.parametrize("split, block, chunk, part", [(phrases.SPLIT, phrases.BLOCK_WORDS, phrases.CHUNK, phrases.SLICE), (200, 500, 300, 7), (40, 2000, 50, 100)])
def test_phrases(spark, monkeypatch, folder, split, block, chunk, part):
    """Also with small blocks and slices, texts read in pieces, and prefixes divided by their second, third and fourth words."""
    monkeypatch.setattr(phrases, "SLICE", part)
    monkeypatch.setattr(phrases, "SPLIT", split)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    op = registry.queries()["op13_phrase_mining"]
    columns, want = sql_rows(f"{folder}/some", OP13_SQL)
    got = op(spark, f"{folder}/some").select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == want
    assert any(r["phrase"].count(" ") == 3 for r in got) and any("\x01" in r["phrase"] for r in got)
    assert op(spark, f"{folder}/none").count() == 0


def test_phrases_against_plain_loops(spark):
    """Counts, weakest cuts and what longer phrases cover, by dictionaries."""
    rows = corpus(11, 200)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"]) for r in phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), 4, 10**6).collect()}
    import re

    f = {}
    for _, t, lang, *_ in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(str.maketrans(divergence.UPPER, divergence.LOWER))):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    want = {}
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= 4}
        for p, a in found.items():
            inside = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * found[q] >= 80 * a for q in inside):
                continue
            cuts = [(int(Fraction(2_000_000 * a, own[p[:k]] + own[p[k:]])), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            want[lang, " ".join(p)] = (a, left, right, score)
    assert got == want and len(want) > 50


def test_growth_is_depth_first():
    a, b, c, d = (np.array(x) for x in ([1, 1, 1, 1, 2], [5, 5, 5, 6, 5], [7, 7, 8, 0, 7], [9, 0, 0, 0, 9]))
    out = []
    phrases.grow([a, b, c, d], np.array([3, 2, 1, 4, 9]), (), 0, 5, 3, out)
    assert out == [((1, 5), 6), ((1, 5, 7), 5), ((1, 5, 7, 9), 3), ((1, 6), 4), ((2, 5), 9), ((2, 5, 7), 9), ((2, 5, 7, 9), 9)]


def test_very_long_texts(spark):
    r = random.Random(1)
    words = " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(400_000))
    docs = spark.createDataFrame([(1, words, "en", "a", 1), (2, "x" * 3_000_000, "en", "b", 1), (3, words + " end", "en", "a", 1)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    got = {x["phrase"]: x["a"] for x in phrases.mine_phrases(docs).collect()}
    own = Counter(zip(words.split(), words.split()[1:]))
    assert all(got[" ".join(k)] == 2 * n for k, n in own.items() if " ".join(k) in got) and got
    assert divergence.source_divergence(docs).where("part = 'pair'").count() == 2
