"""Quality rules, decontamination and personal data against brute force."""
import hashlib
import random
import re
import time

import duckdb
import pytest

from varloom.llm import decontam, pii, quality, queries_decontam, queries_quality

TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h " * 6, "\n".join(["same line here"] * 9), "x" * 3000, "w " * 5000, "   \x1c ok\x0bnext\x0cpage",
    "Ça va bien ## $$ ** && %% || <b> !! !! !!", "A B C D\n\nA B C D\n \nE F", "SHOUT! " * 30, "the quick brown fox jumps over the lazy dog again and then some more words follow here to make it long enough now",
]


def random_texts(n, seed, words="a b c the of fox dog é ## !! A\nB x.y 12 in\tto".split(" ")):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(n)]


def from_sql(sql, **tables):
    db = duckdb.connect()
    for name, (columns, rows) in tables.items():
        db.execute(f"create table {name} ({columns})")
        db.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    got = db.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same_rows(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(rows, key=key)


def test_quality_rows_are_those_of_the_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS + random_texts(150, 5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_rows(queries_quality.op1_quality_rules(spark, str(tmp_path)), *from_sql(queries_quality.OP1_SQL, documents=("doc_id bigint, text varchar", rows)))


def test_cascade_keeps_the_same_in_any_order(spark):
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(TEXTS + random_texts(60, 6))], "doc_id long, text string, failed_rule string, kept boolean")
    kept = {}
    for name, rules in (("own", quality.RULES), ("reversed", quality.RULES[::-1])):
        rows = quality.QualityCascade(rules).transform(docs).collect()
        kept[name] = {r["doc_id"]: r["kept"] for r in rows}
        assert all((r["failed_rule"] is None) == r["kept"] for r in rows)
    assert kept["own"] == kept["reversed"] == {r["doc_id"]: r["kept"] for r in quality.judged(docs, quality.QualityCascade()).collect()}
    cascade = quality.QualityCascade().fit(docs)
    ratio = [cascade.estimates[r.name][0] / cascade.estimates[r.name][1] for r in cascade.rules]
    assert ratio == sorted(ratio, reverse=True) and {r.name for r in cascade.rules} == {r.name for r in quality.RULES}
    empty = docs.limit(0)
    assert quality.QualityCascade().fit(empty).transform(empty).count() == 0
    extra = quality.QualityCascade().transform(docs.selectExpr("doc_id", "text", "1 as words", "2 as lines"))
    assert {r["doc_id"]: r["kept"] for r in extra.collect()} == kept["own"] and {"words", "lines"} <= set(extra.columns)


def test_costs_of_rules_are_net_of_the_job(spark):
    """Windows of eight words cost many times what one comparison does, in every fit."""
    docs = quality.few_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for _ in range(2):
        cost = {name: c for name, (_, c) in quality.QualityCascade().fit(docs).estimates.items()}
        assert cost["repeated_windows"] > 5 * cost["too_short"] and cost["repeated_windows"] == max(cost.values())


def test_sample_is_of_few_files(spark, tmp_path):
    spark.range(200).selectExpr("id as doc_id", "repeat('w ', 30) as text").repartition(20).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert len(quality.few_files(docs, 3).inputFiles()) == 3 and quality.few_files(docs, 99) is docs
    assert quality.few_files(spark.range(3)).count() == 3


ITEMS = [("0", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("10", "short item"), ("2", "x"), ("3", ""), ("4", None), ("5", "a b a b a b a b a b a b a b a b"), ("6", "Short ITEM"), ("7", "été à la plage aujourd'hui")]
DOCS = [None, "", "... !!", "X y z", "a short item; a short item", "One, two three four five SIX seven eight nine ten eleven twelve thirteen. " + "w " * 400, "a b " * 40, "zz " * 300 + "été à LA plage aujourd hui", "nothing here"]


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 30])
def test_decontamination_rows_are_those_of_the_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    r = random.Random(7)
    pieces = "one two three four short item a b x été plage zz".split()
    rows = [(i, t) for i, t in enumerate(DOCS + [" ".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(150)])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries_decontam.op9_decontamination(spark, str(tmp_path))
    same_rows(got, *from_sql(queries_decontam.OP9_SQL, documents=("doc_id bigint, text varchar", rows), benchmark=("item_id varchar, text varchar", ITEMS)))


def test_blocks_of_items_keep_all_columns(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)
    docs = spark.createDataFrame([(1, "short item and x", "k")], "doc_id long, text string, `a b` string").selectExpr("struct(doc_id, `a b`) as _doc", "text")
    row = decontam.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).first()
    assert row["_doc"].asDict() == {"doc_id": 1, "a b": "k"} and (row["n_hit"], row["n_items"], row["text"]) == (3, 3, "short item and x")


def test_pieces_of_an_item_have_all_its_windows(monkeypatch):
    for most in (1, 30, 100, decontam.BLOCK_WORDS):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", most)
        for n in (0, 1, 12, 13, 14, 15, 27, 200):
            words = [b"%d" % i for i in range(n)]
            got = [w for piece in decontam._pieces(words) for w in decontam.windows_of(piece)]
            assert got == decontam.windows_of(words)


def test_decontamination_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_words long")
    none = spark.createDataFrame([], "item_id string, text string")
    row = decontam.find_contamination(docs, none).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"], row["text"]) == (2, 0, False, "a b")
    assert decontam.find_contamination(docs.limit(0), none).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile("[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = digits(m)
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    parts = ["a", "b.", "@", "@", ".", "-", "+", "1", "2", "25", ".9", " ", "(", ")", "é", "%", "4111111111111111", "0", "x@y.z", "١", "+1 (22"]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def models():
    return pii.train()


def test_trees_on_examples_they_have_not_seen(models, capsys):
    x, kinds, y = pii.examples(6000, 99)
    lines = []
    for k, kind in enumerate(pii.KINDS):
        own = kinds == k
        chosen = models[k].probability(x[own]) >= models[k].threshold
        precision, recall = y[own][chosen].mean(), chosen[y[own] > 0].mean()
        lines.append(f"{kind}: precision {precision:.2f}, recall {recall:.2f} of {int(y[own].sum())} among {own.sum()} candidates")
        assert precision > 0.85 and recall > 0.4, lines[-1]
        assert not chosen.all()
    with capsys.disabled():
        print("\n" + "\n".join(lines))


def test_trees_keep_and_reject_candidates_of_documents(spark, models):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    _, scored = pii.judged(models, texts)
    kept = [texts[i][c[0] : c[2]] for i, c, p in scored if p >= models[c[1]].threshold]
    gone = [texts[i][c[0] : c[2]] for i, c, p in scored if p < models[c[1]].threshold]
    assert len(kept) >= 5 and len(gone) >= 5
    # what was planted as a secret is kept, and a number that is no card's is left alone
    assert sum(bool(re.fullmatch("[0-9a-f]{40}", x)) for x in kept) >= 5 and any(re.fullmatch("[0-9]{16}", x) for x in gone)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("please call 555-123-4567 tomorrow", ["phone:12:24"]), ("the order 555-123-4567 was late", []), ("call +1 (826) 555-4081 190.137.223.20", ["phone:5:22"]),
        ("my ssn 123-45-6789 is", ["ssn:7:18"]), ("she was born on 12/03/1980 there", ["birth:16:26"]), ("published 12/03/1980 by", []),
        ("IBAN DE89370400440532013000 please", ["iban:5:27"]), ("IBAN DE88370400440532013000 please", []), ("ask Mr Paul Keller about it", ["name:7:18"]),
        ("she lives at 12 Baker Street now", ["address:13:28"]), ("commit 1eb9c654e721b4f812088970e66a6345cee33dd6 of", []), ("version 1.2.3.4000 was", []),
        ("server 2001:db8::8a2e:370:7334 of", ["ip:7:30"]), ("look at this dot and", []), ("write to ann at mail dot org now", ["email:9:28"]),
    ],
)
def test_context_decides(models, text, spans):
    base, every = pii.all_spans(models, [text])
    got = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every[0] if (a, k, b) not in base[0]]
    assert got == spans


def test_spans_and_redaction(spark):
    rows = [
        (1, None), (2, ""), (3, "mail jo@x.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (743) 555-3824."),
        (4, 'the token = "1eb9c654e721b4f812088970e66a6345cee33dd6" is'), (5, "nothing: 3.14 = pi, chapter 2"), (6, "ann (at) mail (dot) org"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as spans", "'k' as n_email")
    got = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    for i, t in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert (got[3]["n_email"], got[3]["n_ip"], got[3]["n_card"], got[3]["n_phone"]) == (1, 1, 1, 1)
    assert got[4]["spans"].startswith("secret:13:53") and got[5]["spans"] == "" and got[6]["spans"].startswith("email:0:")
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text == {1: None, 2: "", 3: "mail [EMAIL] or [IP], card [CARD], [PHONE].", 4: 'the token = "[SECRET]" is', 5: rows[4][1], 6: "[EMAIL]"}
    assert pii.redact(docs).columns == docs.columns and pii.find_spans(docs.limit(0)).count() == 0


def test_patterns_take_linear_time(models):
    hard = ["a", "1", "1.", "a@", "+1", "key=", "AB12 ", "x(at)", " ", "123 456 ", "Mr A", "a1-", "1:2", "12 Aa ", "1 (", "+1 ("]
    pii.all_spans(models, ["+1" + x * (300_000 // len(x)) for x in hard])


def test_many_spans_take_linear_time(models):
    """10 MB of telephone numbers, mail addresses and other candidates: base spans and candidates are found by bisection."""
    line = "call +1 (743) 555-3824 or 5553824, mail jo@x.org\n"
    text = line * (10_000_000 // len(line))
    base = pii.base_spans(text)
    taken = pii._Taken(base)
    began = time.perf_counter()
    found = sum(taken.free(a, a + 9) for a in range(0, len(text), 20))
    assert len(base) > 200_000 and 0 < found < len(text) // 20 and time.perf_counter() - began < 10
    small = line * 200
    want_base, want = pii.all_spans(models, [small])
    assert all(b <= a for (_, _, b), (a, _, _) in zip(want[0], want[0][1:])) and set(want_base[0]) <= set(want[0])
    began = time.perf_counter()
    base, every = pii.all_spans(models, [line * 8000])
    took = time.perf_counter() - began
    print(f"{8000 * len(line)} characters with {len(every[0])} spans: {took:.1f} s")
    assert len(every[0]) == 40 * len(want[0]) and took < 60


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 30])
def test_items_without_an_id_count_for_hits(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    items = [*ITEMS, (None, "nothing here"), (None, "zz zz"), (None, "short item"), (None, None)]
    rows = list(enumerate(DOCS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries_decontam.op9_decontamination(spark, str(tmp_path))
    row = got.where("doc_id = 8").first()
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (2, 0, True)
    same_rows(got, *from_sql(queries_decontam.OP9_SQL, documents=("doc_id bigint, text varchar", rows), benchmark=("item_id varchar, text varchar", items)))


def test_long_secrets_are_covered_to_their_end(models):
    r = random.Random(5)
    for n in (63, 201, 400, 900):
        secret = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(n))
        text = f'the token = "{secret}" is'
        assert [s for s in pii.all_spans(models, [text])[1][0] if s[1] == pii.SECRET] == [(13, pii.SECRET, 13 + n)]
