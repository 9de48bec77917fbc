"""Reply trees to training conversations: paths by self-joins, ranked branches, a reversible template."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens.llm.common import sha, stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
_BACK = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    """Text without ``<`` and ``[``, so that it holds no control string of this template or of others."""
    for plain, safe in _ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    head, *rest = text.split("\\\\")
    parts = [head, *rest]  # between doubled escapes each escape is a single letter
    return "\\".join(p.replace("\\l", "<").replace("\\b", "[") for p in parts)


def format_turns(turns) -> tuple[str, list[int]]:
    """(formatted text, flat list of starts and ends of the loss mask) of (role, text) pairs."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, body = part.partition(TEXT)
        turns.append((unescape(role), unescape(body[:-len(END)])))
    return turns


def _tree_key(name: str):
    """Trees by a string that also tells a null apart."""
    return F.coalesce(F.concat(F.lit("t"), F.col(name).cast("string")), F.lit("null"))


def paths(messages: DataFrame, keep: int = 1, tree: str = "tree_id", msg: str = "msg_id", parent: str = "parent_id",
          score: str = "score") -> DataFrame:
    """Rows (_tree, branch, seq, msg) of the ``keep`` best root-to-leaf paths of each tree, seq counting down from the leaf's depth.

    Self-joins that double their reach give every message its distance and summed score from the
    root; leaves are ranked in their tree by mean score of the path, ties by the smaller leaf id;
    the stored reaches then enumerate the ancestors of the chosen leaves only, again doubling. The
    number of joins is the logarithm of the depth, and ids alone move. Files of ids are far smaller
    than their rows, so the joins are told not to be broadcast on the files' size. A parent that does not exist
    makes a root; messages on a cycle of parents are on no path; a null score is 0. Message ids are
    unique in a tree; rows without one are on no path.
    """
    nodes = messages.select(_tree_key(tree).alias("_tree"), F.col(msg).alias("msg"), F.col(parent).alias("up"),
                            F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("sum")).where(F.col("msg").isNotNull())
    known = nodes.select("_tree", F.col("msg").alias("up"), F.lit(True).alias("_there"))
    reach = nodes.join(known.hint("merge"), ["_tree", "up"], "left").select(
        "_tree", "msg", F.when(F.col("_there"), F.col("up")).alias("up"), "sum", F.lit(1).cast("long").alias("n"))
    first = stored(reach)
    # Messages that have reached their root leave; the others look up where they stand.
    closed, open_ = first.where(F.col("up").isNull()), first.where(F.col("up").isNotNull())
    reaches, rounds = [open_.select("_tree", "msg", "up")], first.count().bit_length() + 1
    while len(reaches) <= rounds and not open_.isEmpty():
        far = closed.unionByName(open_).select("_tree", F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("n").alias("_n"))
        moved = stored(open_.join(far.hint("merge"), ["_tree", "up"]).select(
            "_tree", "msg", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("n") + F.col("_n")).alias("n")))
        closed, open_ = closed.unionByName(moved.where(F.col("up").isNull())), moved.where(F.col("up").isNotNull())
        reaches.append(open_.select("_tree", "msg", "up"))
    rooted = closed
    parents = reaches[0].select("_tree", F.col("up").alias("msg")).distinct()
    leaves = rooted.join(parents.hint("merge"), ["_tree", "msg"], "left_anti")
    order = W.partitionBy("_tree").orderBy(F.desc(F.col("sum") / F.col("n")), "msg")
    walk = (leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep)
            .select("_tree", "branch", F.col("n").alias("seq"), "msg"))
    walk = stored(walk)
    for k, up in enumerate(reaches[:-1]):  # the last is empty, or of cycles only
        higher = walk.join(up.hint("merge"), ["_tree", "msg"]).select("_tree", "branch", (F.col("seq") - 2**k).alias("seq"), F.col("up").alias("msg"))
        walk = stored(walk.unionByName(higher))
    return walk


def format_trees(messages: DataFrame, keep: int = 1, tree: str = "tree_id", msg: str = "msg_id", parent: str = "parent_id",
                 score: str = "score", role: str = "role", text: str = "text") -> DataFrame:
    """One row per chosen branch: tree id, branch rank, formatted conversation, loss spans (starts and ends, code points).

    A null role or text is empty. A conversation is one row, so its turns meet in one place; trees
    of any size move as ids until their branches are chosen. An empty table gives an empty result;
    other columns are not read.
    """
    said = messages.select(_tree_key(tree).alias("_tree"), F.col(tree).alias("_id"), F.col(msg).alias("msg"),
                           F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    turns = (paths(messages, keep, tree, msg, parent, score).join(said.hint("merge"), ["_tree", "msg"])
             .groupBy("_tree", "branch").agg(F.first("_id").alias(tree), F.sort_array(F.collect_list(
                 F.struct("seq", "_role", "_text"))).alias("turns")).select(tree, "branch", "turns"))
    schema = turns.select(tree, "branch", F.lit("").alias("formatted"), F.array(F.lit(0).cast("long")).alias("loss_spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["_role"], t["_text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=[tree, "branch", "formatted", "loss_spans"])

    return turns.mapInArrow(run, schema)


def read_back(formatted: DataFrame, tree: str = "tree_id") -> DataFrame:
    """Digests of what a formatted conversation says, from its text and loss spans alone."""
    schema = (formatted.select(F.col(tree)).withColumn("n_turns", F.lit(0).cast("long")).withColumn("turns_sha256", F.lit(""))
              .withColumn("loss_chars", F.lit(0).cast("long")).withColumn("loss_sha256", F.lit(""))
              .withColumn("formatted_chars", F.lit(0).cast("long")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), sha(said.encode()), len(loss), sha(loss.encode()), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))],
                names=[tree, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(tree, "formatted", "loss_spans").mapInArrow(run, schema)
