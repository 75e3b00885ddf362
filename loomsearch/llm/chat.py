"""Chat formatting from reply trees.

Messages form trees by parent id. Iterative self-joins find every root-to-leaf path by doubling:
jump[j] leads 2^j replies up, and each leaf's list of ancestors doubles with it, so a tree of depth
d takes about 2 log2(d) joins, on ids alone. Branches are ranked by score; each chosen path is
formatted as one conversation. DataFrame expressions only.

Template: <|im_start|>role\\ntext<|im_end|>\\n for each turn. Inside texts and roles a backslash is
doubled and <| becomes <\\|, in roles a line feed becomes \\n too, so no text can end its own turn and
parse() gives everything back. The loss mask covers the texts of assistant turns.

Defined cases: a null text or role is empty; a reply whose parent is missing, is itself or does not
come before it (order) starts a tree, which also cuts cycles; null conversation ids are one
conversation; equal scores are ranked by leaf id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, up) for every root-to-leaf path: node is `up` replies above leaf.

    nodes: conv (a non-null key), node, parent, ord; node is unique in conv.
    """
    up = nodes.select("conv", F.col("node").alias("parent"), F.col("ord").alias("parent_ord"))
    linked = nodes.join(up, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("parent_ord") < F.col("ord"), F.col("parent")).alias("up"))
    linked = materialise(linked, "replies")
    parents = linked.where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    jump = linked.where("up is not null")
    found = linked.join(parents, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    reach = 1
    while True:
        # All ancestors nearer than `reach` are known; those up to 2 * reach lie one jump above them.
        far = found.join(jump.withColumnRenamed("up", "above"), ["conv", "node"]).select("conv", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        found = materialise(found.unionByName(far), "paths")
        high = jump.select("conv", F.col("node").alias("via"), F.col("up").alias("above"))
        jump = materialise(jump.withColumnRenamed("up", "via").join(high, ["conv", "via"]).select("conv", "node", F.col("above").alias("up")), "jumps")
        reach *= 2
        if jump.isEmpty():
            return found


def best_paths(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """Paths with their rank in the conversation: by the mean score of their messages, highest first. keep: so many a conversation."""
    every = paths(nodes)
    scored = every.join(nodes.select("conv", "node", "score"), ["conv", "node"])
    ranked = scored.groupBy("conv", "leaf").agg(F.avg("score").alias("path_score")).withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc_nulls_last("path_score"), "leaf")))
    ranked = ranked if keep is None else ranked.where(F.col("rank") <= keep)
    return every.join(ranked, ["conv", "leaf"])


def formatted(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation a chosen path: conv, leaf, rank, path_score, formatted and loss_spans (begin, end in code points of formatted).

    messages: conv, node, role, text.
    """
    body = escape(F.coalesce("text", F.lit("")))
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.struct((-F.col("up")).alias("at"), head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    whole = chosen.join(messages, ["conv", "node"]).groupBy("conv", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        spans = F.when(F.coalesce(t["loss"], F.lit(False)), F.concat(acc["spans"], F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).cast("long").alias("at"), spans.alias("spans"))

    spans = F.aggregate("turns", start, step)["spans"]
    return whole.select("conv", "leaf", "rank", "path_score", text.alias("formatted"), spans.alias("loss_spans"))


def parse(text: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    def turn(x: Column) -> Column:
        own = F.substring(x, len(START) + 1, 1 << 30)
        cut = F.locate("\n", own)
        role = own.substr(F.lit(1), cut - 1)
        # A line feed inside a role was written as \n, a backslash doubled: undo both in one pass over the pairs.
        plain = F.array_join(F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")
        return F.struct(plain.alias("role"), unescape(own.substr(cut + 1, F.lit(1 << 30))).alias("text"))

    return F.transform(pieces, turn)


def masked(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(text.substr((s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))))


def chain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and messages of linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Rows of one turn follow each other by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    keyed = numbered.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), "conv_id", "node", "role", "text")
    keyed = materialise(keyed, "turns")
    nodes = keyed.select("conv", "node", (F.col("node") - 1).alias("parent"), F.col("node").alias("ord"), F.lit(0.0).alias("score"))
    return nodes, keyed
