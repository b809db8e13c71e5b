"""Chat formatting of reply trees.

Messages are nodes with a parent. Self-joins double, each round, the stretch of the way up that
every node knows: its ancestor 2^k steps up, and the sum of the scores and the number of
messages on the way there. So a thread of d messages takes log2(d) joins, a round holds one row
a node, and no text moves. A node that has reached its root has its branch's score; leaves are
ranked by it within their root, and only the chosen leaves' paths are enumerated, by the same
doubling. Each chosen path becomes one conversation. A table of conversations is a forest of
chains: the reply to a turn is the next turn.

Template: ``<turn>role<body>text</turn>`` and a line feed a turn. Inside role and text a
backslash is written ``\\b`` and ``<`` is written ``\\l``, so no control string can occur in
them and both replacements undo in any place. The loss mask lists the code-point spans of
assistant texts in the formatted string.

Defined cases: a null text or role is empty, a null score is 0; turns that tie are ordered by
role, then text; rows that repeat a turn are turns of their own; a null conv_id is a conversation
of its own. In trees, of rows that repeat a node the one of the smallest (parent, score, role,
text) stays, a null node is one node that nothing replies to, a parent that is not in the table
makes its reply a root, and nodes on a cycle of parents, or below one, have no root and are in no
path. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.workspace import written


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of linear conversations (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str, null_safe: bool = False) -> Column:
    """Rows of one tree whose node ``a`` is ``b``; the other side's tree is called ``t``."""
    return F.col("tree").eqNullSafe(F.col("t")) & (F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b))


def distinct_nodes(messages: DataFrame) -> DataFrame:
    """The messages, one a node. Texts are grouped only if a node does repeat."""
    if messages.groupBy("tree", "node").count().filter("count > 1").isEmpty():
        return messages
    rest = ["parent", "score", "role", "text"]
    return messages.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("m")).select("tree", "node", *[f"m.{c}" for c in rest])


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, node, root, branch_score and turns (its place below the root, from 1) of every node with a root, and the
    jumps (tree, node, up) of 1, 2, 4, ... steps; the messages have one row a node."""
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    ups = nodes.join(known, _same("parent", "p"), "left").select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("turns"))
    at = written(ups.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), "chat-climb")
    most = at.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, step = [], 1
    while step <= most:
        open_ = at.filter("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("tree", "node", "up"))
        on = at.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("score").alias("more"), F.col("turns").alias("also"), F.col("root").alias("top"))
        longer = open_.join(on, _same("up", "n")).select("tree", "node", F.col("further").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("turns") + F.col("also")).alias("turns"), F.col("top").alias("root"))
        at = written(at.filter("up is null").unionByName(longer), "chat-climb")
        step *= 2
    # a way up that has not ended after as many steps as the largest tree has nodes is a cycle
    return at.filter("up is null").select("tree", "node", "root", F.col("score").alias("branch_score"), "turns"), jumps


def _leaves(messages: DataFrame, best: int | None) -> tuple[DataFrame, list[DataFrame]]:
    nodes, jumps = climbed(messages)
    replied = messages.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = nodes.join(replied, _same("node", "p"), "left_anti").withColumnRenamed("node", "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.desc("branch_score"), "leaf")))
    return ranked.filter(F.col("rank") <= best) if best else ranked, jumps


def choose(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, root, leaf, branch_score, turns and rank of the ``best`` branches of each root (None: all): highest score first, then the smallest leaf."""
    return _leaves(written(distinct_nodes(messages).select("tree", "node", "parent", "score"), "chat-nodes"), best)[0]


def paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """tree, leaf, node and depth (0 at the leaf) of the ways from the given leaves to their roots."""
    found = written(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth")), "chat-paths")
    for k, jump in enumerate(jumps):
        # what lies below 2^k steps is known: each of those gives the one 2^k further up
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"))
        longer = found.join(j, _same("node", "n", null_safe=True)).select("tree", "leaf", F.col("further").alias("node"), (F.col("depth") + 2**k).alias("depth"))
        found = written(found.unionByName(longer), "chat-paths")
    return found


def format_paths(messages: DataFrame, best: int | None = 1, learn: str = "assistant") -> DataFrame:
    """tree, leaf, formatted (string) and loss_spans (array of start, length in code points from 0) of every chosen path."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    messages = distinct_nodes(written(messages.select("tree", "node", "parent", "score", *texts), "chat-messages"))
    nodes = written(messages.select("tree", "node", "parent", "score"), "chat-nodes")
    chosen = paths(*_leaves(nodes, best))
    own = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == learn).alias("learn"))
    turns = chosen.join(own, _same("node", "n", null_safe=True))
    turns = turns.withColumn("head", F.concat(F.lit("<turn>"), "role", F.lit("<body>"))).withColumn("whole", F.concat("head", "text", F.lit("</turn>\n")))
    part = F.struct((-F.col("depth")).alias("at"), "whole", F.char_length("head").alias("skip"), F.char_length("text").alias("n"), F.char_length("whole").alias("chars"), "learn")
    talk = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    spans = F.aggregate(
        "parts",
        start,
        lambda a, p: F.struct(
            (a["at"] + p["chars"]).alias("at"),
            F.when(p["learn"], F.array_append(a["spans"], F.struct((a["at"] + p["skip"]).alias("start"), p["n"].alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return talk.select("tree", "leaf", F.array_join(F.transform("parts", lambda p: p["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """The formatted conversations with ``turns`` (array of role, text), taken apart again, and ``loss_text``, what lies under the mask."""
    whole = F.filter(F.split("formatted", "</turn>\n"), lambda s: s != "")
    turns = F.transform(whole, lambda s: F.struct(unescape(F.split_part(F.substr(s, F.lit(7)), F.lit("<body>"), F.lit(1))).alias("role"), unescape(F.split_part(s, F.lit("<body>"), F.lit(2))).alias("text")))
    masked = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})
