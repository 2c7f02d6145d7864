"""Chat formatting from reply trees: iterative self-joins enumerate the root-to-leaf
paths, branches are ranked by score, and every chosen path becomes one conversation.
DataFrame functions only.

Paths come from jump pointers: level k of the pointer table holds each message's
2^k-th ancestor and is one self-join of level k-1, so a chain of 400 replies takes nine
joins instead of 400, and a path's rows are only made for its own leaf.

Defined cases: a null role or text is empty; a null tree id is a tree of its own; a
message whose parent is absent is a root; messages on a cycle of parents reach no root
and form no path; equal rows are separate turns; ties between turns are ordered by role
and text, ties between branches by length and then by the smallest leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm.shared import store

TURN, END, ESCAPE = "<|turn|>", "<|end|>", "\\"
#: fixed values: control strings and the letter that stands for each after the escape character
CONTROL = {
    TURN: "t", END: "e", "<|im_start|>": "i", "<|im_end|>": "j", "<|endoftext|>": "x",
    "<s>": "s", "</s>": "z", "[INST]": "u", "[/INST]": "v", "<<SYS>>": "y", "<</SYS>>": "w",
}
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """Double the escape character, then replace each control string by an escape pair."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control, letter in CONTROL.items():
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + letter))
    return out


def unescape(text: Column) -> Column:
    """Exact inverse: cut at doubled escape characters, then undo the pairs in each piece."""
    def undo(piece: Column) -> Column:
        for control, letter in CONTROL.items():
            piece = F.replace(piece, F.lit(ESCAPE + letter), F.lit(control))
        return F.replace(piece, F.lit(ESCAPE + "n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undo), ESCAPE)


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, up) for every message ``node`` that lies ``up`` steps above a leaf.

    ``messages`` has ``node`` and ``parent`` (null at a root), both strings.
    """
    jump = store(messages.select("node", F.col("parent").alias("up_node")).where("up_node is not null"), "jump0")
    levels, most = [], messages.count()
    while (1 << len(levels)) <= most and not jump.isEmpty():
        levels.append(jump)
        a, b = jump.alias("a"), jump.alias("b")
        jump = store(a.join(b, F.col("a.up_node") == F.col("b.node")).select("a.node", "b.up_node"),
                     f"jump{len(levels)}")
    inner = messages.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    paths = messages.select("node").join(inner, "node", "left_anti").select(
        F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(levels))):
        higher = (paths.alias("p").join(levels[k].alias("j"), F.col("p.node") == F.col("j.node"))
                  .select("p.leaf", F.col("j.up_node").alias("node"), (F.col("p.up") + (1 << k)).alias("up")))
        paths = store(paths.unionByName(higher), f"paths{k}")
    return paths


def format_trees(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, score, formatted text and loss spans.

    ``messages``: tree, node, parent (strings), role, text, score. A path's score is the
    sum of its messages' scores; the best ``paths_per_tree`` of each tree are formatted.
    ``loss`` holds, for each assistant turn, the turn's number, the offset of its text
    inside that turn and inside the whole, and its length (code points).
    """
    m = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select(F.col("node").alias("parent"))
    m = store(m.join(known.withColumn("found", F.lit(True)), "parent", "left")
              .select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("parent"), "role", "text", "score"), "messages")
    paths = root_to_leaf_paths(m)
    scored = paths.join(m.select("node", "tree", "score", F.col("parent").isNull().alias("root")), "node")
    ranked = (scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.max("root").alias("whole"))
              .where("whole").withColumn("rank", F.row_number().over(
                  W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf"))).where(F.col("rank") <= paths_per_tree))
    body = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(ESCAPE + "n")), F.lit("\n"))
    turns = (paths.join(ranked.select("leaf", F.col("score").alias("path_score"), "n", "rank"), "leaf")
             .join(m.select("node", "tree", "role", "text"), "node")
             .select("tree", "leaf", "path_score", "rank", (F.col("n") - F.col("up") - 1).alias("pos"),
                     "role", body.alias("head"), escape(F.col("text")).alias("body")))
    size = F.char_length("head") + F.char_length("body") + len(END) + 1
    before = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    turn = F.struct("pos", "role", F.concat("head", "body", F.lit(END), F.lit("\n")).alias("block"), "at",
                    F.char_length("head").alias("start"), F.char_length("body").alias("length"))
    whole = turns.groupBy("tree", "leaf", "path_score", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda x: x["role"] == ASSISTANT), lambda x: F.struct(
        x["pos"].cast("int").alias("turn"), x["start"].alias("start_in_turn"),
        (x["at"] + x["start"]).alias("start"), x["length"].alias("length")))
    return whole.select("tree", "leaf", F.col("path_score").alias("score"), "rank",
                        F.array_join(F.transform("turns", lambda x: x["block"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: ``turns`` (role, text) and ``loss_text`` under the mask, unescaped."""
    blocks = formatted.withColumn("blocks", F.expr("slice(split(formatted, '<\\\\|turn\\\\|>', -1), 2, 2147483647)"))

    def parse(block: Column) -> Column:
        cut = F.instr(block, "\n")
        return F.struct(unescape(F.substring(block, 1, cut - 1)).alias("role"),
                        unescape(F.substring(block, cut + 1, F.char_length(block) - cut - len(END) - 1)).alias("text"))

    loss_text = F.array_join(F.transform("loss", lambda x: unescape(F.substring(
        F.get("blocks", x["turn"]), x["start_in_turn"] - len(TURN) + 1, x["length"]))), "")
    return blocks.withColumn("turns", F.transform("blocks", parse)).withColumn("loss_text", loss_text).drop("blocks")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each turn answers the turn before it."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    pos = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = (conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("pos", pos))
    return rows.select("tree", F.concat_ws("/", "tree", "pos").alias("node"),
                       F.when(F.col("pos") > 1, F.concat_ws("/", "tree", F.col("pos") - 1)).alias("parent"),
                       "role", "text", F.lit(1.0).alias("score"))
