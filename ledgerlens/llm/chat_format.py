"""Chat formatting of reply trees.

A tree's messages name their parents.  Iterated self-joins double the distance to a known
ancestor, so a tree of depth d takes about log2(d) joins however many rows it has.  On the way
each message gathers its nearest ``NEAR`` ancestors in an array; the same tables, taken from the
longest jump to the shortest of NEAR, then list every NEAR-th ancestor of the chosen leaves, and
the arrays list those between, each exactly once.  Only keys and scores move in these joins; the
messages are written once, and texts are joined at the end.  Branches are ranked in their tree by
the sum of their messages' scores (ties: the longer, then the smaller leaf), and each chosen path
becomes one formatted conversation.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline for every turn.  In texts a
backslash is put between ``<`` and ``|`` (after it, where backslashes stand there already), so no
text can hold a control string and the original is read back exactly; roles are URL-encoded.

Defined results: null texts and roles are empty; a message whose parent is missing or null is a
root; paths that lead into a cycle have no root and are left out; rows with one key are separate
messages, in the order of role and text; repeated rows of ``chain`` are repeated turns; an empty table
gives an empty one; a conversation is one row, however long its texts are; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
#: Ancestors that a message lists itself, a power of two.
NEAR = 16


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def chain(turns: DataFrame, tree: str, order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """A tree table of conversations without branches: the turn before is the parent."""
    rows = turns.select(turns[tree].alias("tree"), *[turns[o].alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    w = Window.partitionBy("tree").orderBy(*[f"o{i}" for i in range(len(order))], "role", "text")
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _up(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join ``key`` of the left table to ``r_node`` of the right one, in the same tree."""
    return left.join(right, left["tree"].eqNullSafe(right["r_tree"]) & (left[key] == right["r_node"]), how)


def choose_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows tree, leaf, rank, node, depth (0 at the root) of the best ``branches`` paths of each tree.

    nodes: tree, node (unique in its tree), parent, score.
    """
    ids = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nowhere = F.array().cast(f"array<{ids.schema['node'].dataType.simpleString()}>")
    # ancestor: at the end of the jump, found missing by the next one; above: the ancestors before it, the nearest first;
    # jump, score: messages and their scores from the node up to where it ends, or to the root, where that is reached
    jumps, total = [ids.select("tree", "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("jump"), "score", nowhere.alias("above"))], ids.count()
    ended = []  # messages whose root is reached are not joined again
    while 2 ** len(jumps) <= 2 * total and jumps[-1].where("ancestor is not null").head(1):
        step, gathers = jumps[-1].where("ancestor is not null"), 2 ** len(jumps) <= NEAR
        ended.append(jumps[-1].where("ancestor is null"))
        other = reduce(DataFrame.unionByName, ended, step).select(F.col("tree").alias("r_tree"), F.col("node").alias("r_node"), *[F.col(c).alias(f"r_{c}") for c in ("ancestor", "jump", "score", *(["above"] if gathers else []))])
        met = F.col("r_node").isNotNull()
        above = F.when(met, F.concat("above", F.array("r_node"), "r_above")).otherwise(F.col("above")) if gathers else F.col("above")
        step = _up(step, other, "ancestor", "left").select(
            "tree", "node", F.col("r_ancestor").alias("ancestor"), (F.col("jump") + F.coalesce("r_jump", F.lit(0))).alias("jump"),
            (F.col("score") + F.coalesce("r_score", F.lit(0.0))).alias("score"), above.alias("above"))
        jumps.append(materialize(step, "chat-jump"))
    # one table: an anti join of a union becomes one join for each of its parts
    last = materialize(reduce(DataFrame.unionByName, ended, jumps[-1]), "chat-ends")
    inner = ids.where("parent is not null").select(F.col("tree").alias("r_tree"), F.col("parent").alias("r_node")).distinct()
    leaves = _up(last.where("ancestor is null"), inner, "node", "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("jump"), "node")
    path = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("jump") - 1).alias("depth"), "above")
    far, written = [k for k in range(len(jumps) - 2, 0, -1) if 2**k >= NEAR], [*jumps[1:], last]
    if far:
        path = path.drop("above")
        for k in far:
            up = jumps[k].where("ancestor is not null").select(F.col("tree").alias("r_tree"), F.col("node").alias("r_node"), "ancestor")
            higher = _up(path, up, "node", "inner").select("tree", "leaf", "rank", F.col("ancestor").alias("node"), (F.col("depth") - 2**k).alias("depth"))
            path = materialize(path.unionByName(higher), "chat-path")
            written.append(path)
        path = _up(path, last.select(F.col("tree").alias("r_tree"), F.col("node").alias("r_node"), "above"), "node", "inner")
    listed = path.select("tree", "leaf", "rank", "depth", F.posexplode(F.concat(F.array("node"), "above")).alias("back", "node"))
    listed = materialize(listed.select("tree", "leaf", "rank", "node", (F.col("depth") - F.col("back")).alias("depth")), "chat-path")
    discard(*written)
    return listed


def format_trees(nodes: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row a chosen path: tree, leaf, rank, formatted, mask (array of start, stop code points under the loss)."""
    nodes = materialize(nodes, "chat-nodes")
    path = choose_paths(nodes, branches)
    bodies = nodes.select(F.col("tree").alias("r_tree"), F.col("node").alias("r_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _up(path, bodies, "node", "inner").select("tree", "leaf", "rank", "depth", "role", "text")
    turn = F.struct("depth", F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("mask")),
        lambda a, t: F.struct(
            (a.at + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["loss"], F.concat(a.mask, F.array(F.struct((a.at + F.length(t["head"])).alias("start"), (a.at + F.length(t["head"]) + F.length(t["body"])).alias("stop"))))).otherwise(a.mask).alias("mask")),
        lambda a: a.mask,
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select("tree", "leaf", "rank", text.alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.endswith(p, F.lit(END)))

    def turn(p: Column) -> Column:
        head = F.length(F.substring_index(p, "\n", 1))
        body = F.substr(p, head + 2, F.length(p) - head - 1 - len(END))
        return F.struct(F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))), "")
