"""Chat formatting from reply trees.

Messages point to what they answer. Iterative self-joins, each reaching twice as far up
as the one before, list every path from a root to a leaf; branches of a tree are ranked
by score, and each chosen path becomes one conversation.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is put after the ``<`` of every ``<|`` (and of every ``<\\...\\|``), so neither
can hold a control string, and taking one backslash out restores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import cut_lineage, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the ranges (code points) of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escaped(text)
        parts += [head, body, END, "\n"]
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        out.append((_unrole(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, up): every node on the path from each leaf to its root, ``up`` steps above the leaf.

    messages: node and parent (null, or no node: a root). In round k each listed path
    end reaches the ancestor 2^k steps further up, so rounds grow with the logarithm of
    the longest thread. A message that answers itself, or a ring of messages, has no leaf
    and is in no path.
    """
    up = cut_lineage(messages.select("node", F.col("parent").alias("above")).where("parent is not null and parent != node"), "reply-links")
    up = cut_lineage(up.join(messages.select(F.col("node").alias("above")), "above", "left_semi"), "reply-links")
    leaves = messages.select("node").join(up.select(F.col("above").alias("node")), "node", "left_anti")
    found = cut_lineage(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "reply-paths")
    reach = 1
    while True:
        further = found.join(up, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        more = cut_lineage(further, "reply-paths")
        if more.isEmpty():
            return found
        found = cut_lineage(found.unionByName(more), "reply-paths")
        up = cut_lineage(up.join(up.select(F.col("node").alias("above"), F.col("above").alias("top")), "above").select("node", F.col("top").alias("above")), "reply-links")
        reach *= 2


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Paths with the rank of their branch within its tree: (leaf, node, up, tree, branch_score, branch_rank).

    messages: node, parent, tree, score (null: 0). A branch scores the mean of its
    messages; equal scores rank by leaf. ``best``: branches to keep per tree, all where None.
    """
    steps = paths(messages).join(messages.select("node", "tree", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    scored = steps.groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("branch_score"))
    if best is None:
        # all branches are kept: count those of one tree in order of their score
        ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    else:
        ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))).where(F.col("branch_rank") <= best)
    return steps.drop("tree", "score").join(ranked, "leaf")


def threads(conversations: DataFrame) -> DataFrame:
    """Conversation rows as messages: each answers the one before it, in order of turn.

    Rows of one turn stand in order of role and text. node is unique over the table, the
    rank of the turn within its conversation; null conversations form one tree.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("place", F.row_number().over(order))
    key = lambda place: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), place.cast("string"))
    return placed.select(key(F.col("place")).alias("node"), F.when(F.col("place") > 1, key(F.col("place") - 1)).alias("parent"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), F.lit(1.0).alias("score"), "conv_id", "role", "text")


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by leaf and from the root down become one row per leaf; a path may span batches."""
    leaf, turns, head = None, [], None

    def row():
        text, spans = formatted(turns)
        return (*head, text, [{"start": a, "end": b} for a, b in spans])

    columns = ["leaf", "conv_id", "branch_rank", "formatted", "loss_spans"]
    for batch in batches:
        out = []
        for this, conv, rank, role, text in zip(batch["leaf"], batch["conv_id"], batch["branch_rank"], batch["role"], batch["text"]):
            if this != leaf:
                if turns:
                    out.append(row())
                leaf, turns, head = this, [], (this, conv, rank)
            turns.append((text_or_empty(role), text_or_empty(text)))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
    if turns:
        yield pd.DataFrame([row()], columns=columns).astype({"conv_id": "Int64"})


WRITTEN = "leaf string, conv_id bigint, branch_rank int, formatted string, loss_spans array<struct<start:int,end:int>>"


def conversations_of(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One formatted conversation per chosen path, with the ranges (code points) that carry loss.

    messages: node, parent, tree, score, conv_id, role, text. A conversation is one row
    and must fit in a task, as it must for whoever reads it.
    """
    chosen = branches(messages, best).join(messages.select("node", "conv_id", "role", "text"), "node")
    ordered = chosen.select("leaf", "conv_id", "branch_rank", "up", "role", "text").repartition("leaf").sortWithinPartitions("leaf", F.desc("up"))
    return ordered.mapInPandas(_written, WRITTEN)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    for batch in batches:
        out = []
        for conv, text, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"]):
            turns = read_back(text)
            learned = [unescaped(text[s["start"] : s["end"]]) for s in spans]
            out.append((conv, len(turns), sha(x for r, t in turns for x in (r, "\n", t, "\n")), sum(map(len, learned)), sha(learned), len(text)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def digested(written: DataFrame) -> DataFrame:
    """Turns and loss text as read back from the formatted strings."""
    return written.select("conv_id", "formatted", "loss_spans").mapInPandas(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
