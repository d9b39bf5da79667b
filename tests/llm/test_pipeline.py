"""The pipeline, stage by stage, against brute force on small documents."""
import hashlib
import re

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_groups import close, groups, near_copies, plain_fingerprint
from tests.llm.test_text_rules import TEXTS, plain_spans
from varloom.llm import decontam

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omicron"


def plain_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    if len(words) < 20:
        return False
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    distinct = len(set(words))
    return not (
        100 * len(repeated) > 30 * len(words) or 10 * len(re.findall("[#*$%&|<>]", t)) > len(words) or 2 * t.count("!") > len(words)
        or 10 * len(re.findall("[A-Z]", t)) > 4 * len(t) or 10 * (len(lines) - len(set(lines))) > 4 * len(lines)
        or 20 * distinct < len(words) and distinct < 200 or len(t) > 40 * len(words)
    )


def documents():
    clean = [" ".join(f"w{i * j % 97}{'abc'[j % 3]}" for j in range(1, 40)) for i in range(1, 12)]
    texts = TEXTS + near_copies(8, 40) + clean + [clean[0] + " " + ITEM, clean[1] + " mail jo@x.org at 10.0.0.1", clean[1] + " mail jo@x.org at 10.0.0.1", "w " * 300 + ITEM]
    return [(i * 17 % 211, t, "en", "s", None if t is None else len(t), i, "extra") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"


def test_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([("b", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = {r[0]: r for r in rows}
    assert len(now) == len(rows)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)

    def step(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    one = step(names[0], docs)
    assert one.columns == docs.columns
    want = {i: r for i, r in now.items() if plain_quality(r[1])}
    assert {r["doc_id"]: tuple(r) for r in one.collect()} == want

    two = step(names[1], one)
    prints = {i: plain_fingerprint(r[1]) for i, r in want.items()}
    top = groups(set(prints.values()), close(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[top[p]] = min(i, least.get(top[p], i))
    want = {i: r for i, r in want.items() if least[top[prints[i]]] == i}
    assert two.columns == docs.columns and {r["doc_id"]: tuple(r) for r in two.collect()} == want

    three = step(names[2], two)
    item = ITEM.split()
    grams = {tuple(item[i : i + 13]) for i in range(3)}

    def contaminated(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        hit = {i + j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in grams for j in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    want = {i: r for i, r in want.items() if not contaminated(r[1])}
    assert {r["doc_id"]: tuple(r) for r in three.collect()} == want and len(want) < two.count()

    four = step(names[3], three)
    found = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == docs.columns and set(found) == set(want)
    changed = [i for i, r in want.items() if plain_spans(r[1])]
    assert changed and all("jo@x.org" not in r["text"] and r["n_chars"] == len(r["text"]) for r in found.values())
    assert all(found[i]["text"] == r[1] for i, r in want.items() if i not in changed)

    library = Tokenizer.from_file(P.path(corpus_pipeline.VOCABULARY))
    for r in step(names[4], four).collect():
        ids = library.encode(found[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_columns_keep_their_values_whatever_their_names(spark, tmp_path, monkeypatch):
    """Each stage on its own leaves columns alone that have the names which operators use inside."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    inner = ["_row_key", "_row_name", "_redacted", "_row", "_doc", "_text", "_spans", "_items", "_q", "fp", "spans", "contaminated", "node"]
    rows = [(i, t, *[f"{c}{i}" for c in inner]) for i, t in enumerate(r[1] for r in documents())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in inner))
    spark.createDataFrame([(f"b{i}", ITEM + f" x{i}") for i in range(40)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and got and all([r[c] for c in inner] == [f"{c}{r['doc_id']}" for c in inner] for r in got), name


def test_run_and_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([("b", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 10
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
