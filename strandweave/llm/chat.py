"""Chat formatting of reply trees, with DataFrame functions only.

Messages point to the message that they answer. Self-joins that double their reach in each round find how far each
message is from its root, and the sum of the scores on the way; leaves are ranked by the mean score of their messages.
Only the paths of chosen leaves are then expanded, by the same doubled steps, and each becomes one conversation in the
template: ``<|turn|>role<|body|>text<|end|>`` for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, filled, staged

# The template's control strings. All begin with "<|", which escaped texts never contain.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Backslashes are doubled and one is put into each "<|", so that no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def from_turns(turns: DataFrame) -> DataFrame:
    """tree, id, parent, role, text, score of linear conversations (conv_id, turn, role, text): each row answers the row
    before it. Rows are in the order of turn, nulls first; rows of one turn in that of role and text. Repeated rows are
    turns of their own; an empty table gives none."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _far(step: DataFrame) -> DataFrame:
    return step.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"))


def _at(left: DataFrame, column: str) -> Column:
    return left["tree"].eqNullSafe(F.col("_tree")) & (left[column] == F.col("_id"))


def climb(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """steps[k] (tree, id, up): the message 2 ** k above each that has one; and leaves (tree, leaf, length, total): the
    messages that none answers, with the number of messages and the sum of scores from the root to them.

    ``messages`` has tree, id, parent, score. Of rows that repeat a tree and id, one counts: that of the smallest
    parent, then of the smallest score. A parent that doesn't exist makes a root. Messages that never reach a root, as
    they run into a cycle, have no leaf. All joins are on (tree, id), which no skew touches; their number grows with the
    logarithm of the deepest path.
    """
    first = F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("first")
    ids = staged(messages.where("id is not null").groupBy("tree", "id").agg(first).select("tree", "id", "first.*"), "messages")
    known = ids.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    up = ids.join(known, _at(ids, "parent"), "left").select("tree", "id", F.col("_id").alias("up"), "score")
    parents = staged(up, "parents")
    answered = parents.where("up is not null").select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).distinct()
    # length and total: of the messages from each one up to, not including, the one that ``up`` names
    made = [staged(parents.select("tree", "id", "up", F.lit(1).cast("long").alias("length"), F.col("score").alias("total")), "jump")]
    steps, rows, extent = [], made[0].count(), 1
    known, open_ = made[0].where("up is null"), made[0].where("up is not null")
    while extent <= rows and not open_.isEmpty():  # messages that have reached their root take part no more
        steps.append(open_)
        beyond = known.union(open_).select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("length").alias("_length"), F.col("total").alias("_total"))
        further = open_.join(beyond, _at(open_, "up"))
        made.append(staged(further.select("tree", "id", F.col("_up").alias("up"), (F.col("length") + F.col("_length")).alias("length"), (F.col("total") + F.col("_total")).alias("total")), "jump"))
        known, open_, extent = known.union(made[-1].where("up is null")), made[-1].where("up is not null"), 2 * extent
    # those that circle never come to an end
    leaves = known.join(answered, _at(known, "id"), "left_anti").select("tree", F.col("id").alias("leaf"), "length", "total")
    out = staged(leaves, "leaves")
    discard(ids, parents, *made[len(steps) :])
    return steps, out


def choose_leaves(leaves: DataFrame, top: int | None) -> DataFrame:
    """``leaves`` with branch_score and branch_rank: the ``top`` ones of each tree by mean score, then by the smaller id.

    The best one is found with partial maxima; for more, each task drops what can't be among its tree's ``top``. If
    ``top`` is None all leaves are taken and none is ranked, as a tree can have any number.
    """
    scored = leaves.withColumn("branch_score", F.col("total") / F.col("length"))
    if top is None:
        return scored.withColumn("branch_rank", F.lit(None).cast("int"))
    if top == 1:
        best = F.max(F.struct("branch_score", (-F.col("leaf")).alias("_low"), "leaf", "length", "total")).alias("best")
        return scored.groupBy("tree").agg(best).select("tree", "best.leaf", "best.length", "best.total", "best.branch_score", F.lit(1).alias("branch_rank"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    return scored.withColumn("branch_rank", rank).where(F.col("branch_rank") <= top)


def expand(steps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """tree, leaf, branch_rank, node, height: each leaf's path, from the leaf (height 0) up to its root."""
    paths = leaves.select("tree", "leaf", "branch_rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for k, step in enumerate(steps):
        more = paths.join(_far(step), _at(paths, "node")).select("tree", "leaf", "branch_rank", F.col("_up").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        old, paths = paths, staged(paths.union(more), "paths")
        if k:
            discard(old)
    return paths


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, leaf, branch_rank, formatted, loss_spans: one row for each chosen branch.

    ``messages``: tree, id, parent, role, text, score. formatted holds the turns from the root on. loss_spans is an array
    of (start, length) in code points of formatted: the bodies of the assistant's turns. A null role or text is empty, a
    null score 0; a null tree is one tree of its own; rows with a null id are on no path. Of rows that repeat a tree and
    id, one counts, as ``climb`` and the smallest role and text say. Ties of scores go to the smaller leaf. No messages
    give no rows. Further columns, whatever their names, are not looked at. Texts are of any length that fits a row
    together with the others of their path. branch_rank is null if ``top`` is.
    """
    messages = messages.select("tree", "id", "parent", "role", "text", "score")
    steps, leaves = climb(messages)
    chosen = expand(steps, staged(choose_leaves(leaves, top), "chosen"))
    discard(*steps, leaves)
    turn = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    body = escape(filled())
    said = messages.where("id is not null").groupBy("tree", "id").agg(F.min(F.struct("role", "text")).alias("one")).select("tree", "id", "one.*").select(
        F.col("tree").alias("_tree"), F.col("id").alias("_id"), turn.alias("head"), body.alias("body"), F.col("role").eqNullSafe(F.lit(TRAINED_ROLE)).alias("trained")
    )
    lines = chosen.join(said, chosen["tree"].eqNullSafe(F.col("_tree")) & (chosen["node"] == F.col("_id")))
    gathered = lines.groupBy("tree", "leaf", "branch_rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("at"), "head", "body", "trained"))).alias("turns"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    none = F.array().cast("array<struct<start:long,length:long>>")
    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def add(acc, t):
        start, n = acc["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(END)).alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return gathered.select("tree", "leaf", "branch_rank", whole.alias("formatted"), F.aggregate("turns", first, add, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` (columns formatted, loss_spans) with turns, an array of (role, text), and loss_text, both unescaped."""
    turns = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))

    def parse(turn):
        role, rest = F.substring_index(turn, BODY, 1), F.substring_index(turn, BODY, -1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.transform(turns, parse), "loss_text": F.concat_ws("", masked)})


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the formatted text."""
    back = read_back(formatted)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
