"""Reply trees: choose root-to-leaf paths by score and format each as one conversation, in native expressions.

A message names its parent; a tree's conversations are its paths from the root to a leaf.  Paths are followed by iterative
self-joins of the table of jumps: joined with itself, the jumps of 2^k replies give those of 2^(k+1), so a thread of
n replies takes log2(n) joins, and sums of scores come along.  Per tree the `paths` best leaves (greater sum of scores,
then lesser node) are chosen; going back over the tables of jumps lists the messages of their paths, each once.

The template marks a turn as `[INST]role\\ntext[/INST]` (user), `<s>role\\ntext</s>` (assistant) or `[SYS]role\\ntext[/SYS]`
(any other role).  Control strings inside roles and texts get a backslash after their first character, and backslashes
are doubled, so that none of them is left inside a text and `unescaped` gives back exactly what went in.

Defined results: a null text or role is empty; a parent that is not in the tree makes a root; a null tree id is a tree of
its own; messages of a path are in the order of replies.  A cycle of parents is an error.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.base import written

MAX_ROUNDS = 40

#: Control strings of the template: opening and closing mark for each kind of role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "other": ("[SYS]", "[/SYS]")}

_CONTROL = r"([<\[])(/?s>|/?INST\]|/?SYS\])"
_BROKEN = r"([<\[])\\(/?s>|/?INST\]|/?SYS\])"
_CLOSE = r"</s>|\[/INST\]|\[/SYS\]"
_OPEN = r"^(<s>|\[INST\]|\[SYS\])"


def escaped(text: Column) -> Column:
    """The text with no control string of the template left in it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _BROKEN, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("[\\NL]"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("[\\NL]"), F.lit("\n")))


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str, paths: int = 1) -> DataFrame:
    """(tree, path, node, back): the messages of the `paths` best root-to-leaf paths of each tree.

    path is the path's leaf, back the number of replies from the message to the leaf.
    """
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("anc"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("sum"))
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    on = lambda a: a["tree"].eqNullSafe(F.col("t")) & (a["anc"] == F.col("n"))
    rows = written(rows.join(known, on(rows), "left").select("tree", "node", F.col("n").alias("anc"), "sum"), "chat-jumps")
    # messages whose jump is past the root are done and not joined again
    done, live = rows.where("anc is null"), rows.where("anc is not null")
    jumps = []
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        jumps.append(live)
        step = done.unionByName(live).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("anc").alias("next"), F.col("sum").alias("more"))
        far = written(live.join(step, on(live)).select("tree", "node", F.col("next").alias("anc"), (F.col("sum") + F.col("more")).alias("sum")), "chat-jumps")
        done, live = done.unionByName(far.where("anc is null")), far.where("anc is not null")
    else:
        raise ValueError("parents form a cycle")
    parents = rows.where("anc is not null").select(F.col("tree").alias("t"), F.col("anc").alias("n")).distinct()
    sums = done
    leaves = sums.join(parents, sums["tree"].eqNullSafe(F.col("t")) & (sums["node"] == F.col("n")), "left_anti")
    if paths == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("sum")).alias("s"), F.col("node").alias("node"))).alias("b")).select("tree", F.col("b.node").alias("path"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node"))
        best = leaves.withColumn("r", rank).where(F.col("r") <= paths).select("tree", F.col("node").alias("path"))
    chosen = best.select("tree", "path", F.col("path").alias("node"), F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "anc")
        up = chosen.join(step, chosen["tree"].eqNullSafe(F.col("t")) & (chosen["node"] == F.col("n")))
        chosen = written(chosen.unionByName(up.select("tree", "path", F.col("anc").alias("node"), (F.col("back") + (1 << k)).alias("back"))), "chat-paths")
    return chosen


def format_paths(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score", paths: int = 1) -> DataFrame:
    """(tree, path, formatted, segments): each chosen path as one conversation.

    segments is array<struct<text, loss>>: `formatted` in pieces, with the loss mask: only assistants' texts carry loss.
    """
    chosen = reply_paths(messages, tree, node, parent, score, paths)
    said = messages.select(
        F.col(tree).alias("t"), F.col(node).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    rows = chosen.join(said, chosen["tree"].eqNullSafe(F.col("t")) & (chosen["node"] == F.col("n")))
    kind = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("other")
    mark = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in MARKS.items() for x in (k, v[i])]), kind)
    piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    turn = F.array(
        piece(F.concat(mark(0), _escaped_role(F.col("role")), F.lit("\n")), F.lit(False)),
        piece(escaped(F.col("text")), F.col("role") == "assistant"),
        piece(mark(1), F.lit(False)),
    )
    rows = rows.select("tree", "path", F.struct((-F.col("back")).alias("at"), turn.alias("turn")).alias("m"))
    talks = rows.groupBy("tree", "path").agg(F.array_sort(F.collect_list("m")).alias("m"))
    talks = talks.select("tree", "path", F.flatten(F.transform("m", lambda x: x["turn"])).alias("segments"))
    return talks.select("tree", "path", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.split(formatted, _CLOSE)
    bodies = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.regexp_replace(t, _OPEN, ""))
    return F.transform(
        bodies,
        lambda b: F.struct(
            _unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescaped(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(segments: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
