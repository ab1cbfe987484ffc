"""Chat formatting of reply trees (operator 4).

Messages name their parents. Self-joins that double the reach of a pointer enumerate the paths from root to leaf: after
k rounds every message knows its ancestor 2^k steps above, its depth and its path's score, so a chain of n messages
takes log2(n) rounds and rows never outnumber the messages. Leaves are ranked by their path's score within their tree;
the messages above a chosen leaf are marked by going the same pointers from the longest to the shortest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learnt.
LEARNT = "assistant"
#: Punctuation that a role keeps as it is; line ends, `<`, `%` and what isn't ASCII are percent-encoded.
PLAIN = " !\"#$&'()*+,/:;=>?@[\\]^`{|}"


def escaped(text: str) -> str:
    """The text without control strings: a backslash after each `<` that `|` or a backslash follows."""
    return re.sub(r"<(?=[|\\])", r"<\\", text)


def unescaped(text: str) -> str:
    return text.replace("<\\", "<")


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of it (code points, end exclusive) that are learnt."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{quote(role, safe=PLAIN)}\n", escaped(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def turns_of(conversation: str) -> list[tuple[str, str]]:
    """What formatted() was given, read from its text."""
    found = []
    for part in conversation.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        found.append((unquote(role), unescaped(text)))
    return found


def unique(messages: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score: one row for each node of a tree.

    Of rows that name the same node the first stays, in the order of parent, role, text and score (null first). A null tree is
    the one without a name; messages without a node are each their own, equal ones are one.
    """
    node = F.coalesce(F.col("node").cast("string"), F.concat(F.lit("\0"), F.md5(F.to_json(F.struct("parent", "role", "text", "score")))))
    named = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), node.alias("node"), F.col("parent").cast("string").alias("parent"), "role", "text", F.col("score").cast("double").alias("score"))
    return named.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")


def linked(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """messages: tree, node (unique in its tree), parent (node of the tree, or null), score. Returns (tree, node, depth, total,
    leaf) for messages with a root, and for each round the pointers (tree, node, up).

    A parent that isn't in the tree makes a root. Messages on a loop, or that hang on one, have no root and are left out: their
    pointers are still there when they reach over as many steps as there are messages.
    """
    known = messages.select(F.col("tree").alias("known_tree"), F.col("node").alias("known"))
    base = messages.join(known, (F.col("tree") == F.col("known_tree")) & (F.col("parent") == F.col("known")), "left")
    base = stored(base.select("tree", "node", F.col("known").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")))
    state = base
    jumps: list[DataFrame] = []
    n = state.count()
    while 1 << len(jumps) <= n and not (on := state.filter("up is not null")).isEmpty():
        jumps.append(on.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("total").alias("a_total"))
        # Only messages that are still on their way are joined; depth and total cover the message and those up to, not with, `up`.
        moved = on.join(above, ["tree", "up"]).select("tree", "node", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"), (F.col("total") + F.col("a_total")).alias("total"))
        state = stored(state.filter("up is null").unionByName(moved))
    parents = base.filter("up is not null").select("tree", F.col("up").alias("node"), F.lit(False).alias("leaf")).distinct()
    rooted = state.filter("up is null").join(parents, ["tree", "node"], "left")
    return rooted.select("tree", "node", "depth", "total", F.coalesce("leaf", F.lit(True)).alias("leaf")), jumps


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """tree, path (1 is best), node, depth: the messages of each tree's `paths` best leaves; messages as unique() has them.

    Leaves rank by mean score of their path, then length (longer first), then node.
    """
    rooted, jumps = linked(messages)
    rooted = stored(rooted)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node"))
    marked = rooted.filter("leaf").withColumn("path", rank).filter(F.col("path") <= paths).select("tree", "path", "node")
    for jump in reversed(jumps):
        both = F.explode(F.array_compact(F.array("node", "up")))
        marked = marked.join(jump, ["tree", "node"], "left").select("tree", "path", both.alias("node"))
    # A message is reached by one sum of powers of two, so no path has it twice.
    return marked.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def format_trees(messages: DataFrame, paths: int = 1) -> DataFrame:
    """messages: tree, node, parent, role, text, score. One row per chosen path: tree, path, conversation string,
    spans array<struct<start, end>> (what is learnt, in code points of conversation).

    A conversation is a run of `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts and roles are escaped; turns_of()
    reads them back. Null roles and texts are empty. Nodes are of their tree; repeated nodes, null nodes and trees as in unique().
    Trees without a leaf (loops) give no row. An empty table gives none. Other columns are not read. One path, however long, is one row
    and so one task's, as is its longest text.
    """
    messages = stored(unique(messages))
    chosen = best_paths(messages.select("tree", "node", "parent", "score"), paths)
    turns = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.select("tree", "path", F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    listed = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("path"), pa.array([c for c, _ in made], pa.string()), spans], ["tree", "path", "conversation", "spans"])

    return listed.mapInArrow(run, "tree string, path int, conversation string, spans array<struct<start: long, end: long>>")


def from_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations that are lists of turns: each turn answers the one before it.

    Turns that share a number stand in the order of role and text; a null number comes first. Null conversations are one. A
    repeated turn stays repeated. Other columns are not read. An empty table gives no messages. Texts are not looked into.
    """
    rows = turns.select(F.col(f"`{conv_col}`").cast("string").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("tree", F.coalesce("conv", F.lit("null")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", place)
    return rows.select("tree", F.col("place").cast("string").alias("node"), F.when(F.col("place") > 1, (F.col("place") - 1).cast("string")).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(conversations: DataFrame) -> DataFrame:
    """Of each formatted conversation, what is read back from it."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for tree, text, spans in zip(batch.column("tree").to_pylist(), batch.column("conversation").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = turns_of(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                rows.append((None if tree == "null" else int(tree), len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in names.split(", ")])

    return conversations.select("tree", "conversation", "spans").mapInArrow(run, names)
