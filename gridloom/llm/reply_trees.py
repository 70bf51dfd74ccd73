"""Chat formatting: from reply trees to training conversations.

Messages point to the message that they answer. Self-joins double the reach of each pointer, so a tree of
depth d takes about log2(d) of them; on the way they sum the scores up to the root. The leaves of a tree are
ranked by the score of their path, the paths of the best are read off the same doubled pointers, and each
becomes one conversation in a template whose control strings cannot be forged by a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle

# ---- template: <s>[ROLE]role[/ROLE]text</s>, an assistant's text under the loss mask ----
_CONTROL = r"(/?s>|/?ROLE\]|/?INST\])"
_TO_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_TO_RESTORE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    r"""Put a backslash after the first character of each control string, and one more where backslashes stand there already."""
    return _TO_ESCAPE.sub(r"\1\\\2\3", text)


def restore(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _TO_RESTORE.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted, spans of code points under the loss mask) of (role, text) turns; empty texts have an empty span."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        turns.append((restore(m[1]), restore(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


def best_paths(messages: DataFrame, *, top: int = 1) -> DataFrame:
    """messages (tree_id, node_id, parent_id, score, ...) -> tree_id, path_rank, position, node_id.

    The ``top`` root-to-leaf paths of each tree by the sum of their scores (null: 0), ties going to the
    smaller leaf; positions count from 0 at the root. A message without a parent, or whose parent is not in
    its tree, is a root, and each of a tree's roots has its paths. Messages in or under a cycle lie on no
    path. node_id must be unique in its tree; rows without one are left out. Rows without a tree_id are one
    tree of their own. An empty table gives an empty one.
    """
    given = messages.select("tree_id", "node_id", F.nullif("parent_id", "node_id").alias("parent_id"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).where("node_id is not null")
    m = settle(given)  # ids and scores only: texts are not part of any of these joins
    up = m.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    # a null tree_id names a tree like any other
    on = lambda c: F.col("tree_id").eqNullSafe(F.col("t")) & (F.col(c) == F.col("n"))
    rooted = m.join(up, on("parent_id"), "left").select("tree_id", "node_id", F.col("n").alias("jump"), "score", F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    jumps = [settle(rooted)]
    state = jumps[0]
    # of a chain, each round settles some messages; when a round settles none, only cycles are left
    pending, before = state.where("jump is not null").count(), -1
    while pending not in (0, before):
        far = state.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("jump").alias("far"), F.col("score").alias("more"), F.col("depth").alias("down"))
        # a message that has reached its root needs no join any more
        both = state.where("jump is not null").join(far, on("jump"), "left")
        moved = both.select("tree_id", "node_id", F.col("far").alias("jump"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("down", F.lit(0))).alias("depth"))
        state = settle(moved.union(state.where("jump is null")))
        jumps.append(state)
        pending, before = state.where("jump is not null").count(), pending
    parents = m.where("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("n")).distinct()
    leaves = state.where("jump is null").join(parents, on("node_id"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "node_id"))
    paths = leaves.withColumn("path_rank", rank).where(F.col("path_rank") <= top).select("tree_id", "path_rank", F.col("depth").alias("position"), "node_id")
    # every distance from the leaf is a sum of distinct powers of two
    for k in reversed(range(len(jumps) - 1)):
        hop = jumps[k].where("jump is not null").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "jump")
        here = F.struct(F.col("position"), F.col("node_id"))
        there = F.struct((F.col("position") - (1 << k)).alias("position"), F.col("jump").alias("node_id"))
        both = paths.join(hop, on("node_id"), "left")
        paths = both.select("tree_id", "path_rank", F.explode(F.when(F.col("jump").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select("tree_id", "path_rank", "x.*")
    return paths


def conversations(messages: DataFrame, *, top: int = 1, learn: str = "assistant") -> DataFrame:
    """messages (tree_id, node_id, parent_id, score, role, text, ...) -> tree_id, path_rank, formatted, loss_spans.

    One row for each chosen path (:func:`best_paths`), its turns in order in the template. loss_spans are the
    code points of ``formatted`` [start, end) that hold the texts of role ``learn``. Null texts and roles
    count as empty. A conversation is one value and has to fit in a worker. Other columns are ignored.
    """
    chosen = best_paths(messages, top=top).withColumnsRenamed({"tree_id": "t", "node_id": "n"})
    said = messages.select("tree_id", "node_id", "role", "text").join(chosen, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    turns = said.groupBy("tree_id", "path_rank").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(x["role"], x["text"]) for x in row], learn) for row in b.column(2).to_pylist()]
            spans = pa.array([[{"start": s, "end": e} for s, e in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.string()), spans], ["tree_id", "path_rank", "formatted", "loss_spans"])

    kind = messages.schema["tree_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"tree_id {kind}, path_rank int, formatted string, loss_spans array<struct<start: long, end: long>>")


def chains(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each message answers the one before it.

    Turns that tie are ordered by role and a hash of the text, nulls first, so repeated rows stay apart.
    """
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "hash")
    at = F.row_number().over(line)
    return rows.select("*", F.md5("text").alias("hash")).select(F.col("conv_id").alias("tree_id"), at.alias("node_id"), F.nullif(at - 1, F.lit(0)).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """conversations() -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted text and its spans."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse_turns(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                learned = "".join(restore(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["tree_id"].dataType.simpleString()
    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
