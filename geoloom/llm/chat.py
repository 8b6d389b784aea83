"""Chat formatting from reply trees, with DataFrame functions alone.

Messages point at their parents. Self-joins double the reach of each message's ancestor pointer, so that a tree of
depth d needs about log2(d) joins; the pointers then spread every leaf over its ancestors, which gives all
root-to-leaf paths. Branches are ranked by the mean score of their messages (nulls: 0), ties by the smaller leaf;
the best ``keep`` paths of each root are formatted, each as one conversation.

A turn is written as ``<|role|>`` newline, text, ``<|end|>`` newline. In roles and texts a backslash follows every
``<``, ``[`` and ``|`` and every backslash is doubled, so that no text can spell a marker of this or of common
templates (``</s>``, ``[INST]``); taking these backslashes out restores the text. Spans of the loss mask are
the escaped assistant texts, in code points of the formatted string.

A null role or text is empty. A message whose parent doesn't exist is a root; messages on a cycle reach no root and
raise an error rather than vanish. Repeated keys must not occur in ``format_trees``; ``chain`` gives repeated and
tied rows their own keys. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_MARK = r"([<\[|])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _MARK, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|])\\|\\(\\)", "$1$2")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of linear conversations: each row replies to the one before it.
    Rows with the same turn go by role, then text; a null conversation is one of its own."""
    rows = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, distance) for each leaf and each message between it and its root; distance 0 is the leaf."""
    nodes = messages.select("tree", "id", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    up = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "id", F.col("p").alias("up"))
    up = common.materialize(up, "reach")
    has_child = up.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = up.join(has_child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    at = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("distance"))
    total, reach = up.count(), 1
    up = up.where("up is not null")
    while True:  # up holds the messages that have an ancestor this far; few are left after some rounds
        if up.isEmpty():
            return at
        if reach > total:
            raise ValueError("messages reply in a circle")
        step = up.select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        more = at.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "leaf", F.col("up").alias("id"), (F.col("distance") + reach).alias("distance"))
        at = common.materialize(at.unionByName(more), "paths")
        far = up.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"))
        up = up.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i"))).select("tree", "id", F.col("up2").alias("up"))
        up = common.materialize(up, "reach")
        reach *= 2


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, score, formatted, loss_spans (array of start, end) of the best ``keep`` paths of each root;
    messages: tree, id, parent, role, text, score."""
    body = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    all_paths = paths(messages)
    scored = all_paths.join(body.select("t", "i", "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    ranked = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max_by("id", "distance").alias("root"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= keep)
    chosen = ranked.select(F.col("tree").alias("rt"), F.col("leaf").alias("rl"), "rank", F.col("score").alias("path_score"))
    full = all_paths.join(chosen, F.col("tree").eqNullSafe(F.col("rt")) & (F.col("leaf") == F.col("rl"))).join(body.drop("score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    part = F.struct((-F.col("distance")).alias("at"), F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    turns = full.groupBy("tree", "leaf", "rank", F.col("path_score").alias("score")).agg(F.array_sort(F.collect_list(part)).alias("turns"))
    end = F.lit("<|end|>\n")
    step = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + F.length(end)).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], end)), "")
    return turns.select("tree", "leaf", "rank", "score", text.alias("formatted"), step["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text), unescaped, of a formatted conversation."""
    turns = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(3)), "|>\n", 1)).alias("role"), unescape(F.substr(t, F.instr(t, "|>\n") + 3)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted rows."""
    back = formatted.withColumn("read", parse(F.col("formatted")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    back = back.withColumn("loss", F.array_join(loss, ""))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
