import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from varloom.llm import bpe_codec, token_counts

ALPHABET = list("aabbcé'sltre  \n\t 019.,!?-_|<>\x1c\x85ßÜ中文字😀́ΣİǅЖ\xa0") + [" the", " in", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", "ing", "\r\n", "  ", "ha", "an", "th"]
FIXED = ["", " ", "   ", "aaaaaaaaaaaaaaa", "a  b", "a \n b", " \n", "x" * 5000 + "y", "ha" * 3000, "!" * 500 + "a" * 77, "<|endoftext|>", "<|endoftext", "\x00"]


def texts(n, seed):
    r = random.Random(seed)
    return FIXED + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_counts_are_the_library_s():
    own = token_counts.Counter(token_counts.MergeTable.load(P.path("byte_bpe_50k.json")))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = texts(4000, 1)
    assert own(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_merging_gives_the_library_s_ids():
    table = token_counts.MergeTable.load(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words = ["hello", "aaaaaaa", "internationalization", "zzzzzz", "a"]
    counts, ids = token_counts.merge_all(table, [w.encode() for w in words])
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_small_caches_change_nothing(monkeypatch):
    some = texts(500, 2)
    table = token_counts.MergeTable.load(P.path("byte_bpe_50k.json"))
    want = token_counts.Counter(table)(some)
    monkeypatch.setattr(token_counts, "CACHE_UNITS", 3)
    small = token_counts.Counter(table)
    assert [small([t])[0] for t in some] == want


@pytest.fixture(scope="module")
def tables():
    return bpe_codec.PrefixTables.load(P.path("word_bpe_49k.json"))


def test_ids_and_decoding_are_the_library_s(tables, monkeypatch):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    some = texts(4000, 3)
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    one = bpe_codec.Encoder(tables)
    assert [one.encode(t) for t in some] == want
    together = bpe_codec.Encoder(tables)
    together.learn(some)
    assert [together.encode(t) for t in some] == want
    assert [one.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    for name, value in (("CACHE_UNITS", 2), ("CACHE_WORDS", 2), ("CACHE_PAIRS", 2), ("LOCKSTEP", 3)):
        monkeypatch.setattr(bpe_codec, name, value)
    small = bpe_codec.Encoder(tables)
    for i in range(0, 300, 20):
        small.learn(some[i : i + 20])
        assert [small.encode(t) for t in some[i : i + 20]] == want[i : i + 20]
    monkeypatch.setattr(bpe_codec, "LONG", 1)
    alone = bpe_codec.Encoder(tables)
    assert [alone.encode(t) for t in some[:600]] == want[:600]


def test_queries_on_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "it's a test 123", 7), (3, "it's a test 123", 7), (None, "x" * 200_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), 3, drop_text=True).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 3) for i, t, _ in rows), key=str)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got], key=str) == want
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.codec_digests(docs, P.path("word_bpe_49k.json"), drop_text=True).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert got == {(r[0], len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids)}
    both = bpe_codec.decode(bpe_codec.encode(docs, P.path("word_bpe_49k.json")), P.path("word_bpe_49k.json"))
    assert {(r["doc_id"], r["decoded"]) for r in both.collect()} == {(r[0], library.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids)}
    empty = docs.limit(0)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe_codec.codec_digests(empty, P.path("word_bpe_49k.json")).count() == 0
