"""Chat formatting: the paths of reply trees, each written as one conversation by a template, with its loss mask.

Messages have a tree, an id, the id of the message that they reply to, a role, a text and a score. A message without a
parent in its tree is a root. Self-joins that double their reach find each message's root, its depth and the sum of
the scores on the way; a leaf stands for a branch. Branches of a tree are ranked by their mean score, the highest first
(no score counts as 0, ties by the leaf's id), and ``keep`` of them are chosen, or all. The chosen leaves' paths
are listed by the same jumps, the longest first: as many joins as the depth has binary digits.

Of messages with equal tree and id the least by parent, role, text and score stays. Null trees are one tree. Messages that reply
to each other in a circle, and replies to those, have no root and are in no path.

The template writes a turn as ``[INST]text[/INST]`` (user), ``<s>text</s>`` (assistant), ``[SYS]text[/SYS]`` (system) or
``[ROLE]role[TEXT]text[/ROLE]`` (others), with a line feed behind it. A control string inside a text gets a backslash behind
its first character, and so does one that has backslashes there already; reading takes one away. No control string
begins inside another, so this loses nothing. The loss mask has the place of every assistant text.

A conversation comes in pieces of whole turns, each of some megabytes at most or of one turn, in order; end to end they
are the formatted text. So neither writing nor reading holds more than a piece, though a conversation's turns
are written in one task, in their order. Null texts and roles are empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, nonempty, written

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: Characters of a piece, about.
PIECE = 1 << 20

#: What follows the first character of a control string.
_TAIL = r"(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)"
_CONTROL = re.compile(rf"([\[<])(\\*){_TAIL}")
_ESCAPED = re.compile(rf"([\[<])\\(\\*){_TAIL}")
_TURN = re.compile(
    r"(?:\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]"
    r"|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\])\n",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text begins and ends."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    body = escape(text)
    return f"{head}{body}{tail}\n", len(head), len(head) + len(body)


def turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of each turn, and where the text stands."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        at = found.end()
        name = found.lastgroup
        role = unescape(found["role"]) if name == "text" else name
        yield role, unescape(found[name]), *found.span(name)


def reached(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, id, root, depth, total of every message that has a root; and the jumps to ancestors 1, 2, 4, .. steps up."""
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    here = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    linked = nodes.join(here, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left")
    # ``up`` is the message ``depth`` steps above, null above a root; ``total`` sums the scores below ``up``.
    rows = written(
        linked.select(
            "tree", "id", F.col("i").alias("up"), F.when(F.col("i").isNull(), F.col("id")).alias("root"),
            F.when(F.col("i").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total"),
        )
    )
    size, jumps, reach = rows.count(), [], 1
    done, open_ = rows.where("up IS NULL").drop("up"), rows.where("up IS NOT NULL")
    while reach <= 2 * size and not open_.isEmpty():
        jumps.append(open_.select("tree", "id", "up"))
        # What lies above is another open message, or one that has its root.
        here = done.withColumn("up", F.lit(None).cast("long")).unionByName(open_).select(
            F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("next"), F.col("root").alias("its_root"),
            F.col("depth").alias("more"), F.col("total").alias("its"),
        )
        met = open_.join(here, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")))
        rows = written(
            met.select(
                "tree", "id", F.col("next").alias("up"), F.col("its_root").alias("root"),
                (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("its")).alias("total"),
            )
        )
        done, open_ = done.unionByName(rows.where("up IS NULL").drop("up")), rows.where("up IS NOT NULL")
        reach *= 2
    return done, jumps


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """tree, leaf, branch_score, branch_rank (null where all are kept), place (0 at the root), role, text: the chosen paths.

    ``messages``: tree, id, parent, role, text, score.
    """
    bounded(messages.sparkSession)
    first = F.min(F.struct("parent", "role", "text", "score")).alias("one")
    every = written(messages.groupBy("tree", "id").agg(first).select("tree", "id", "one.*"))
    found, jumps = reached(every)
    parents = every.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p IS NOT NULL").distinct()
    leaves = found.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    leaves = leaves.withColumn("branch_score", F.col("total") / (F.col("depth") + 1))
    rank = F.lit(None).cast("int")
    if keep is not None:  # each task keeps that many of a tree before the shuffle
        order = W.Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "id")
        leaves = leaves.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= keep)
        rank = F.col("branch_rank")
    chosen = leaves.select(
        "tree", F.col("id").alias("leaf"), "branch_score", rank.alias("branch_rank"), F.col("id").alias("node"), F.col("depth").alias("place"),
    )
    for step in reversed(range(len(jumps))):
        jump = jumps[step].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        up = chosen.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("i")))
        up = up.select(
            "tree", "leaf", "branch_score", "branch_rank", F.col("up").alias("node"), (F.col("place") - 2**step).alias("place")
        )
        chosen = written(chosen.unionByName(up))
    bodies = every.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    met = chosen.join(bodies, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("i")))
    return met.select("tree", "leaf", "branch_score", "branch_rank", "place", "role", "text")


def formatted(chosen: DataFrame, piece: int = PIECE) -> DataFrame:
    """tree, leaf, piece (0, 1, ..), formatted, loss (begin and end of each assistant text in the piece) of ``paths``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in nonempty(batches) for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (tree, leaf), some in groupby(rows, key=lambda r: r[:2]):
            text, loss, size, number = [], [], 0, 0
            for _, _, role, said in some:
                role = role or ""
                line, begin, end = turn(role, said or "")
                if text and size + len(line) > piece:
                    yield one(tree, leaf, number, text, loss)
                    text, loss, size, number = [], [], 0, number + 1
                if role == "assistant":
                    loss.append({"begin": size + begin, "end": size + end})
                text.append(line)
                size += len(line)
            yield one(tree, leaf, number, text, loss)

    def one(tree, leaf, number, text, loss) -> pa.RecordBatch:
        columns = [[tree], [leaf], [number], ["".join(text)], [loss]]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "leaf", "piece", "formatted", "loss"])

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(span)]
    rows = chosen.select(F.col("tree").cast("long"), F.col("leaf").cast("long"), "role", "text", "place")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place").drop("place")
    return rows.mapInArrow(
        write, "tree long, leaf long, piece int, formatted string, loss array<struct<begin: long, end: long>>"
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of ``formatted`` conversations, in one pass.

    ``turns_sha256`` is of role, line feed, text and line feed of each turn, ``loss_sha256`` of what the loss mask covers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in nonempty(batches) for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (tree, leaf), some in groupby(rows, key=lambda r: r[:2]):
            said, learned, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, _, text, loss in some:
                size += len(text)
                for role, body, _, _ in turns(text):
                    n += 1
                    said.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["begin"] : span["end"]])
                    chars += len(body)
                    learned.update(body.encode())
            columns = [[tree], [leaf], [n], [said.hexdigest()], [chars], [learned.hexdigest()], [size]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows = pieces.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "piece")
    return rows.select("tree", "leaf", "piece", "formatted", "loss").mapInArrow(
        read, "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def from_turns(conversations: DataFrame) -> DataFrame:
    """``messages`` of conversations (conv_id, turn, role, text): each turn replies to the one before it.

    Turns with equal numbers follow each other by role and text, rows without a number come last.
    """
    order = W.Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    place = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", place - 1)
    return rows.select(
        F.col("conv_id").cast("long").alias("tree"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"),
        "role", "text", F.lit(None).cast("double").alias("score"),
    )


def turns_sql(more: str) -> str:
    """What reading back gives, in DuckDB, by the template's rules; ``more`` are rows of (conv_id, turn, role, text)."""
    control = r"([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)"
    grown = lambda c: f"length(regexp_replace({c}, '{control}', '\\1\\\\\\2\\3', 'g'))"
    return f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {more}),
turns AS (
  SELECT *, {grown("text")} + 1 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 19 + {grown("role")} END AS size
  FROM every)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::bigint AS formatted_chars
FROM turns GROUP BY conv_id"""
