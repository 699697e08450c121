"""Reply trees to chat training text, with DataFrame functions only.

Messages form trees (a parent for each message).  Iterated self-joins double the
distance that each message sees towards its root, so all root-to-leaf paths are
known after log2(depth) rounds, with their length and score; branches are ranked
by score; the chosen paths are enumerated by the same jumps (each message of a
path is made once), and formatted as one conversation.

Template of a turn: ``### <role>: <text></turn>\\n``.  Inside texts and roles a
backslash is doubled, ``### `` becomes ``#\\## `` and ``</turn>`` becomes
``<\\/turn>``; in roles ``: `` becomes ``:\\ ``.  So the control strings stand
nowhere else and ``parse`` restores every text exactly.  The loss mask is a list
of spans (code points) over the formatted text that cover assistant texts.

Defined results: null text or role: empty; null score: 0; a parent that is null
or not in its tree: a root; messages on a cycle belong to no path; a null tree id
is a tree of its own; equal scores: the longer path, then the smaller leaf;
repeated rows of a linear conversation are turns of their own; an empty table
gives an empty result; other columns are not looked at.  One conversation is one
output row, so its text must fit one task; everything else is spread by rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simsift.llm.common import materialize

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.replace(F.replace(text, F.lit("### "), F.lit("#\\## ")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/# ])", "$1")


def linear_trees(turns: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of turns as reply trees of one path: (tree, node, parent, role,
    text, score).  Equal turn numbers are ordered by role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")    # one conversation is one output row anyway
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, **on: str) -> Column:
    """Null-safe equality of trees, and of the named columns a=b."""
    cond = a["tree"].eqNullSafe(b["tree_"])
    for left, right in on.items():
        cond = cond & (a[left] == b[right])
    return cond


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, pos, node): the messages, in order from the root, of the
    ``top`` best-scored root-to-leaf paths of every tree."""
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    here = links.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"))
    hop = materialize(
        links.join(here, _same(links, here, parent="node_"), "left")
        .select("tree", "node", F.col("node_").alias("up"), F.lit(1).cast("long").alias("length"), "score"), "hops")
    # Each round doubles the hop of the messages that do not yet see their root;
    # the others wait, with the length and score of their whole path.
    hops, whole = [], hop.where("up is null")
    largest = hop.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest)) + 1):
        moving = hop.where("up is not null")
        if moving.isEmpty():
            break
        hops.append(moving)
        far = whole.unionByName(moving).select(
            F.col("tree").alias("tree_"), F.col("node").alias("node_"), F.col("up").alias("up_"),
            F.col("length").alias("length_"), F.col("score").alias("score_"))
        hop = materialize(
            moving.join(far, _same(moving, far, up="node_"), "left")
            .select("tree", "node", F.col("up_").alias("up"),
                    (F.col("length") + F.coalesce("length_", F.lit(0))).alias("length"),
                    (F.col("score") + F.coalesce("score_", F.lit(0.0))).alias("score")), "hops")
        whole = whole.unionByName(hop.where("up is null"))
    # Messages on a cycle never see a root.
    parents = links.select(F.col("tree").alias("tree_"), F.col("parent").alias("parent_")).where("parent is not null")
    leaves = whole.join(parents, _same(whole, parents, node="parent_"), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "node")
    path = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "tree", F.col("node").alias("leaf"), "rank", "length", "node", F.lit(0).cast("long").alias("above"))
    for i in reversed(range(len(hops))):
        step = hops[i].select(
            F.col("tree").alias("tree_"), F.col("node").alias("node_"), "up")
        # One row becomes itself and, if there is one, the message 2^i above it.
        both = F.explode(F.array(F.struct("node", "above"), F.struct(
            F.col("up").alias("node"), (F.col("above") + 2 ** i).alias("above"))))
        path = path.join(step, _same(path, step, node="node_"), "left") \
            .select("tree", "leaf", "rank", "length", both.alias("at")) \
            .where("at.node is not null").select("tree", "leaf", "rank", "length", "at.node", "at.above")
    return path.select("tree", "leaf", "rank", (F.col("length") - 1 - F.col("above")).alias("pos"), "node")


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) for the best paths of each tree.
    ``loss_spans`` is an array of (start, end) in code points."""
    path = reply_paths(messages, top)
    said = messages.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), "role", "text")
    turns = path.join(said, _same(path, said, node="node_")).select(
        "tree", "leaf", "rank", "pos", (F.col("role") == ASSISTANT).alias("loss"),
        F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE)).alias("head"),
        escape(F.col("text")).alias("body"))
    turn = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(turn)).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start)
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end"))
    return turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("pos", turn.alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans")).select(
        "tree", "leaf", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")


def parse(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: (tree, leaf, pos, role, text, loss), a
    row for each turn; ``loss`` says whether a loss span covers the text."""
    pieces = formatted.select("tree", "leaf", F.posexplode(F.split("formatted", END)).alias("pos", "turn")) \
        .where("turn <> ''")
    parts = r"(?s)^### (.*?): (.*)$"
    pieces = pieces.select("tree", "leaf", "pos", F.length("turn").alias("size"),
                           F.regexp_extract("turn", parts, 1).alias("head"),
                           F.regexp_extract("turn", parts, 2).alias("body"))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.col("size") + len(END)).over(before), F.lit(0))
                               + len(HEAD) + F.length("head") + len(MIDDLE))
    masked = formatted.select(F.col("tree").alias("tree_"), F.col("leaf").alias("leaf_"),
                              F.explode("loss_spans").alias("span")).select(
        "tree_", "leaf_", F.col("span.start").alias("start_"), F.col("span.end").alias("end_"))
    return pieces.join(masked, _same(pieces, masked, leaf="leaf_", start="start_"), "left").select(
        "tree", "leaf", "pos", unescape(F.col("head")).alias("role"), unescape(F.col("body")).alias("text"),
        F.coalesce(F.col("end_") == F.col("start") + F.length("body"), F.lit(False)).alias("loss"))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    everything read back from the formatted text and its loss mask."""
    formatted = materialize(formatted, "formatted")           # read three times
    turns = parse(formatted).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text", "loss"))).alias("turns")).select(
        F.col("tree").alias("tree_"), F.col("leaf").alias("leaf_"), F.col("turns"),
        F.array_join(F.filter("turns", lambda t: t["loss"])["text"], "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.join(turns, _same(formatted, turns, leaf="leaf_")).select(
        F.col("tree").alias(id_col), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
