"""Conversations and WARC archives: exact round trips, and the rows of their SQL."""
import gzip
import hashlib
import random

import duckdb
import pytest

from varloom.llm import chat, queries_chat, queries_warc, warc

MESSAGES = "tree long, node long, parent long, role string, text string, score double"
HARD = ["</s>[INST] ok [/INST]", "<\\s>", "\\", "\\\\</s>", "[\\NL]", "<s>", "a\nb", "", None, "[/INST", "é😀", "[\\/INST]", "\\<\\/s>"]


def from_sql(sql, name, columns, rows):
    db = duckdb.connect()
    db.execute(f"create table {name} ({columns})")
    if rows:
        db.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    got = db.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same_rows(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("empty", [False, True])
def test_conversations_are_those_of_the_sql(spark, tmp_path, empty):
    r = random.Random(1)
    rows = [] if empty else [(c, t, r.choice(["user", "assistant", "system", "user\n</s>", None]), r.choice(HARD)) for c in range(40) for t in range(r.choice([1, 2, 7, 33]))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_rows(queries_chat.op4_chat_formatting(spark, str(tmp_path)), *from_sql(queries_chat.OP4_SQL, "conversations", "conv_id bigint, turn int, role varchar, text varchar", rows))


def test_repeated_turns_and_null_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in queries_chat.op4_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1), None: (2, 1), -1: (2, len(queries_chat.EXTRA))}


def best_path(nodes):
    """Brute force: every leaf's path by following parents."""
    by = {n: (p, s) for n, p, s in nodes}
    parents = {p for _, p, _ in nodes if p in by}
    out = []
    for leaf in by:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at in by:
            path.append(at)
            at = by[at][0]
        out.append((-sum(by[n][1] for n in path), leaf, path[::-1]))
    return min(out)[2]


def test_best_branch_of_trees(spark):
    r = random.Random(2)
    rows, want = [], {}
    for tree in [*range(12), None]:
        n = r.choice([1, 2, 9, 40])
        nodes = [(i, r.randrange(i) if i and r.random() < 0.97 else (999 if r.random() < 0.5 else None), float(r.randint(0, 3))) for i in range(n)]
        want[tree] = best_path(nodes)
        rows += [(tree, i, p, "user", str(i), s) for i, p, s in nodes]
    got: dict = {}
    for row in chat.reply_paths(spark.createDataFrame(rows, MESSAGES), "tree", "node", "parent", "score").collect():
        got.setdefault(row["tree"], []).append((-row["back"], row["node"]))
    assert {t: [n for _, n in sorted(v)] for t, v in got.items()} == want
    two = chat.format_paths(spark.createDataFrame([(1, 0, None, "user", "hi", 0.0), (1, 1, 0, "assistant", "a", 1.0), (1, 2, 0, "assistant", "b", 2.0)], MESSAGES), paths=2)
    assert sorted(r["formatted"] for r in two.collect()) == ["[INST]user\nhi[/INST]<s>assistant\na</s>", "[INST]user\nhi[/INST]<s>assistant\nb</s>"]
    with pytest.raises(ValueError):
        chat.reply_paths(spark.createDataFrame([(1, 0, 1, "user", "x", 0.0), (1, 1, 0, "user", "x", 0.0)], MESSAGES), "tree", "node", "parent", "score")


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    texts = [t for t in HARD if t is not None] + ["".join(r.choice(["\\", "<", "/", "s>", "[", "INST]", "SYS]", "</s>", "a"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for row in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert row["back"] == row["t"] and not any(m in row["e"] for pair in chat.MARKS.values() for m in pair)


PAGES = "page_id long, url string, html string"


def page_rows():
    long = "<p>" + "x" * 1200
    fake = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" * 40
    r = random.Random(4)
    rows = [(1, "http://b.example.com/x?q=1#top", long), (9, "https://a.example.com/", long), (5, None, long), (2, "http://x\r\ny z", ""), (3, "u", None), (4, "u", "short"), (6, "u", "short"), (7, "u", fake), (8, "v", fake), (10, "v", "é" * 600), (11, "v", "é" * 499 + "ab")]
    return rows + [(100 + i, f"http://h{i % 3}.com/{r.randrange(9)}", r.choice([long, fake, "a" * r.randrange(3000)])) for i in range(150)]


@pytest.mark.parametrize("broadcast, classes", [(warc.BROADCAST_ROWS, warc.CLASSES), (0, ((100, 7), (1100, 2), (1 << 31, 1)))])
def test_pages_are_those_of_the_sql(spark, tmp_path, monkeypatch, broadcast, classes):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "CLASSES", classes)
    spark.createDataFrame(page_rows(), PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(queries_warc.op5_warc(spark, str(tmp_path)), *from_sql(queries_warc.OP5_SQL, "pages", "page_id bigint, url varchar, html varchar", page_rows()))


def test_index_is_in_order_and_archives_are_whole(spark, tmp_path):
    rows = page_rows() + [(9, "https://a.example.com/", "<p>" + "x" * 1200), (None, "n", "no id")]
    pages = spark.createDataFrame([(*r, "y") for r in rows], PAGES + ", digest string").repartition(4)
    index = warc.archive_and_index(pages, f"file://{tmp_path}/archives").collect()
    keys = [(r["url_key"], r["captured"]) for r in index]
    assert keys == sorted(keys) and len(index) == len(rows)
    found = {}
    for name in {r["archive"] for r in index}:
        data = (tmp_path / "archives" / name).read_bytes()
        plain = gzip.decompress(data)
        for fields, block, at in warc.parse_archive(data):
            assert plain[at : at + 8] == b"WARC/1.0" and len(block) == int(fields["Content-Length"])
            found[name, at] = fields
    assert {(r["archive"], r["position"]) for r in index} == set(found)
    whole = {i: (t or "").encode() for i, _, t in rows}
    for r in index:
        assert r["payload_digest"] == hashlib.sha1(whole[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(whole[r["page_id"]])
    empty = warc.archive_and_index(pages.limit(0))
    assert empty.count() == 0


def test_null_ids_and_archives_by_size(spark, tmp_path, monkeypatch):
    long = "y" * 1500
    rows = [(None, "u", long), (None, "u", long), (3, "u", long), (4, "v", long), (4, "v", long), (5, "w", "z" * 70_000), (6, "w", None)]
    for broadcast in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
        index = warc.archive_and_index(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/{broadcast}").collect()
        got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in index)
        assert got == [("3", 1500, "revisit", 4), ("4", 1500, "response", None), ("4", 1500, "response", None), ("5", 70_000, "response", None), ("6", 0, "response", None), ("None", 1500, "revisit", 4), ("None", 1500, "revisit", 4)]
        # the page over 64 KB is in an archive of its own class
        assert sum(r["archive"] == next(x["archive"] for x in index if x["page_id"] == 5) for r in index) == 1


def test_loser_tree():
    r = random.Random(5)
    for k in range(7):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_key():
    assert warc.url_key("https://a.B.com/x/y?z=1#t") == "com,b,a)/x/y?z=1" and warc.url_key("-") == "-)"
