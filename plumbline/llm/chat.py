"""Chat formatting of reply trees, as DataFrame code only.

Messages form trees (message, parent). Paths are found by iterative self-joins that double their reach: after
k rounds a message knows its ancestor 2**k steps up and how many steps it has climbed, so a chain of n messages
takes log2(n) rounds. A leaf ranks by its score, then by depth (deeper first), then by message id; the best
`branches` leaves of each tree are formatted, each path from root to leaf as one conversation.

Template, a turn at a time: <|turn|>ROLE<|text|>TEXT<|end|>. Inside roles and texts, control strings are
broken by one tilde after their first character (<|end|> becomes <~|end|>); a control string that already has
tildes there gets one more, so unescape() gives every text back. Control strings begin with < or [ and hold
neither further in, so none can arise where a text meets the template. The loss mask is a list of
(start, length) in code points: the texts of assistant turns, without template strings.

Cases: a null text or role is empty; a message whose parent is missing from the table, or that is null, starts a tree;
a cycle of parents has no root and gives no conversation; repeated rows of a conversation table are turns of their own; ties in
turn are ordered by role, then text, nulls first; very long texts are formatted whole, and a conversation is one row, so it must
fit a task; an empty table gives no conversation; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpointed

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings: those of the template, and those of templates in wide use.
CONTROL = r"(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROL, "$1$2$3")


def reply_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as a tree: (tree, message, parent, role, text, score).
    Each turn replies to the one before it; message and parent count from 1 within the conversation."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("message"))
    return rows.withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1)).withColumn("score", F.lit(0.0))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, message, depth): the messages of the chosen paths, depth 0 at the root."""
    links = messages.select("tree", "message", "parent")
    own = links.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    # a parent that is not there makes a root
    links = links.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")), "left")
    links = checkpointed(links.select("tree", "message", F.col("m").alias("up")))
    depth = checkpointed(links.filter("up is null").select("tree", "message", F.lit(0).cast("long").alias("depth")))
    climbing, jumps = links.filter("up is not null"), []
    bound = math.ceil(math.log2(max(2, links.count()))) + 1
    # only messages that have not met their root climb on; what is left after `bound` rounds hangs on a cycle
    while climbing.limit(1).count() and len(jumps) <= bound:
        k = len(jumps)
        jumps.append(climbing)
        there = climbing.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("further"), F.lit(None).cast("long").alias("below"))
        there = there.union(depth.select("tree", "message", F.lit(None).cast(messages.schema["parent"].dataType), "depth"))
        near = climbing.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        near = checkpointed(near.select("tree", "message", "further", (F.col("below") + 2**k).alias("depth")))
        depth = checkpointed(depth.union(near.filter("depth is not null").select("tree", "message", "depth")))
        climbing = near.filter("further is not null").select("tree", "message", F.col("further").alias("up"))
    inner = messages.select(F.col("tree").alias("t"), F.col("parent").alias("m")).filter("m is not null").distinct()
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.message") == F.col(f"{b}.message"))
    scored = messages.select("tree", "message", "score").alias("s").join(depth.alias("d"), same("s", "d")).select("s.tree", "s.message", "score", "depth")
    leaf = scored.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), "left_anti")
    rank = W.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), F.col("depth").desc(), "message")
    leaf = leaf.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= branches)
    paths = leaf.select("tree", F.col("message").alias("leaf"), "message", "depth")
    for k in range(len(jumps)):  # after round k, all ancestors up to 2**(k+1) - 1 steps away are there
        step = jumps[k].select(F.col("tree").alias("t"), F.col("message").alias("m"), "up")
        above = paths.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
        # each round starts from a table, so that plans do not double with it
        paths = checkpointed(paths.union(above.select("tree", "leaf", F.col("up").alias("message"), (F.col("depth") - 2**k))))
    return paths


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, formatted, loss_spans array<struct<start,length>>) of each chosen path."""
    paths = chosen_paths(messages, branches)
    rows = messages.select(F.col("tree").alias("t"), F.col("message").alias("m"), "role", "text")
    turns = paths.join(rows, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = turns.select("tree", "leaf", F.struct(F.col("depth").alias("d"), role.alias("r"), text.alias("x")).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["r"], F.lit(TEXT), t["x"], F.lit(END)))
    whole = whole.withColumn("formatted", F.array_join(pieces, ""))
    fixed = len(TURN) + len(TEXT)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + fixed + len(END) + F.length(t["r"]) + F.length(t["x"])).alias("at"),
            F.when(
                t["r"] == LOSS_ROLE,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + fixed + F.length(t["r"])).alias("start"), F.length(t["x"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("tree", "leaf", "formatted", spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role,text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, TEXT)
        role = F.substring(p, F.lit(len(TURN) + 1), at - 1 - len(TURN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, at + len(TEXT), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    rows = formatted.withColumn("_turns", parsed(F.col("formatted"))).withColumn("_loss", masked(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.select(
        F.col("tree").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
