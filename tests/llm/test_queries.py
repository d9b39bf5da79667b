"""The registered queries that have no SQL, on a small table of hard documents and on an empty one, against brute force."""
import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.test_groups import close, groups, near_copies, plain_fingerprint, plain_removed, plain_scores
from tests.llm.test_text_rules import TEXTS, plain_spans
from varloom.llm import lm, pii, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int"
LONG = "a passage of well over fifty bytes that several of the documents have in common, word by word"
ROWS = [(i * 7 % 503, t) for i, t in enumerate([*TEXTS, *near_copies(5, 30), LONG, LONG + " x", "y " + LONG, "é" * 60, "z" + "é" * 60, "mail jo@x.org at 10.0.0.1 or +1 (743) 555-3824", "<|endoftext|> a"])]
OPS = ("op2_token_counts", "op3_bpe_codec", "op6_pii", "op7_simhash_dedup", "op8_substring_dedup", "op10_lm_scoring")


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("queries")
    docs = spark.createDataFrame([(i, t, "en", None, None, 3) for i, t in ROWS], SCHEMA).coalesce(1)
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{folder}/{name}/documents.parquet")
    queries = registry.queries()
    assert all(queries[op](spark, f"{folder}/none").count() == 0 for op in OPS)
    return {op: {r["doc_id"]: r for r in queries[op](spark, f"{folder}/some").collect()} for op in OPS}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_every_document_has_one_row(found):
    assert all(sorted(rows) == sorted(i for i, _ in ROWS) for rows in found.values())


def test_token_counts(found):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(found["op2_token_counts"][i]) == (i, len((t or "").encode()), n, n > 1024)


def test_codec(found):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(found["op3_bpe_codec"][i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_personal_data(found):
    for i, t in ROWS:
        spans, row = plain_spans(t or ""), found["op6_pii"][i]
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[1] == j for s in spans) for j in range(4)]
        assert row["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(row["spans"].split(","))


def test_near_duplicates(found):
    prints = {i: plain_fingerprint(t) for i, t in ROWS}
    top, least = groups(set(prints.values()), close(set(prints.values()))), {}
    for i, p in prints.items():
        least[top[p]] = min(i, least.get(top[p], i))
    assert {i: tuple(r) for i, r in found["op7_simhash_dedup"].items()} == {i: (i, f"{p:016x}", least[top[p]]) for i, p in prints.items()}


def test_substrings(found):
    for i, n, kept, spans in plain_removed([(i, (t or "").encode()) for i, t in ROWS]):
        assert tuple(found["op8_substring_dedup"][i]) == (i, n, n - len(kept), spans, sha(kept))


def test_language_model(found):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(x for i, t in ROWS if not held(i) for x in tokens(t))
    total, distinct = sum(c.values()), len(c)
    scores = dict(plain_scores(ROWS, lm.MINIBATCH))
    for i, t in ROWS:
        row, own = found["op10_lm_scoring"][i], tokens(t)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held(i), len(own), sum(c[x] > 0 for x in own), total)
        assert row["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in own), rel=1e-9)
        assert row["score"] == pytest.approx(scores[i], rel=2e-3)
