"""Suppress repeated submissions for a while after one was taken.

The rule is sequential: a row is taken when no taken row of its key lies at most ``ttl`` before it. It is worked out in
parallel all the same. Time is cut into blocks some suppressions long, and a key's block is the unit of work, so a key
that is never silent is spread over as many tasks as it has blocks. For each row a block can be entered at, one pass finds
the last row that is then taken in the block, and so the entry of the next block. These pointers from block to
block are composed by doubling, in joins: their number is that of the rows near the beginning of blocks that hang
together, not of all rows. With every block's entry known, a second pass takes the rows, each block by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.session import freed, landed_table, reuse, shipped

# Fixed value: how long a submission suppresses its repeats.
TTL_SECONDS = 300
#: Suppressions that a block is long. A task holds the distinct times of one block of one key.
BLOCK = 16


class Blocks:
    """The rows of whole blocks, sorted by block and time, with each row's successor."""

    def __init__(self, group: np.ndarray, into: np.ndarray, ttl: int, length: int):
        self.ttl, self.shift = ttl, (length + ttl).bit_length() + 1
        self.first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        self.number = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(group))))
        #: One sorted scale for all blocks; what is a suppression behind a block's end lies before the next one.
        self.place = (self.number << self.shift) + into
        following = np.searchsorted(self.place, self.place + ttl, side="right")
        same = following < len(group)
        same[same] = self.number[following[same]] == self.number[same]
        self.following = np.where(same, following, -1)

    def last(self, at: np.ndarray) -> np.ndarray:
        """The last row that is taken in the block of each row ``at``, if that one is."""
        at = at.copy()
        while True:
            on = self.following[at] >= 0
            if not on.any():
                return at
            at[on] = self.following[at[on]]

    def taken(self, start: np.ndarray) -> np.ndarray:
        """The rows taken in each block, which is entered at or after ``start`` (times into the block)."""
        at = np.searchsorted(self.place, (np.arange(len(start)) << self.shift) + start)
        at = at[at < np.append(self.first[1:], len(self.place))]
        found = []
        while len(at):
            found.append(at)
            at = self.following[at]
            at = at[at >= 0]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _by_block(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on batches of whole blocks of ``rows`` (key, block, into, ..), by block and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Blocks are told apart by two hashes of key and block.
            g, h = (batch[c].to_numpy() for c in ("group", "check"))
            new = np.flatnonzero((np.diff(g) != 0) | (np.diff(h) != 0)) + 1
            if held and any(held[-1][c][-1].as_py() != batch[c][0].as_py() for c in ("group", "check")):
                new = np.append(0, new)
            if not len(new):
                held.append(batch)
                continue
            cut = int(new[-1])
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
            if whole.num_rows:
                yield work(whole.combine_chunks().to_batches()[0])
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    hashes = {"group": F.xxhash64("key", "block"), "check": F.xxhash64(F.lit("check"), "block", "key")}
    dealt = rows.withColumns(hashes).repartition("group").sortWithinPartitions("group", "check", "into")
    return dealt.mapInArrow(run, schema)


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each block of a batch, in order."""
    change = [np.diff(batch[c].to_numpy(), prepend=batch[c].to_numpy()[:1]) != 0 for c in ("group", "check")]
    return np.cumsum(change[0] | change[1])


def _entries(blocks: DataFrame, rows: DataFrame, ttl: int, length: int) -> DataFrame:
    """(key, block, entry) of the blocks in which rows can still hang on the block before: how far into it it is entered.

    ``blocks``: key, block, stretch (the block that a chain of blocks begins with), low. ``rows``: the rows of blocks of
    chains longer than one block.
    """
    def hop(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Where a block is entered, and how far into the next one that suppresses."""
        into = batch["into"].to_numpy()
        found = Blocks(_groups(batch), into, ttl, length)
        # Entries: all within a suppression of the beginning, and the first one after it.
        at = np.flatnonzero(into <= ttl)
        late = np.searchsorted(found.place, (np.arange(len(found.first)) << found.shift) + ttl, side="right")
        late = late[late < np.append(found.first[1:], len(into))]
        at = np.union1d(at, late)
        until = into[found.last(at)] + ttl - length
        # Entered behind its last row, a block takes nothing and suppresses nothing.
        n = len(found.first)
        every = np.concatenate([at, found.first])
        entry = np.concatenate([into[at], np.full(n, length)])
        until = np.concatenate([until, np.full(n, -1)])
        columns = [batch["key"].take(pa.array(every)), batch["block"].take(pa.array(every)), pa.array(entry), pa.array(until)]
        return pa.record_batch(columns, ["key", "block", "entry", "until"])

    shape = rows.select("key", "block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("until")).schema
    hops = landed_table(_by_block(rows, hop, shape))
    # The next block's entry is its first one behind ``until``.
    asked = hops.select("key", (F.col("block") + 1).alias("block"), F.col("until").alias("at"), F.lit(1).alias("asks"), F.col("entry").alias("from"))
    there = hops.select("key", "block", F.col("entry").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("from"))
    # From late to early; an entry at the very time that is asked for comes after the question.
    back = Window.partitionBy("key", "block").orderBy(F.col("at").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(back)
    following = blocks.select("key", "block").where(F.col("stretch") != F.col("block"))
    jump = asked.join(following, ["key", "block"], "left_semi").unionByName(there).withColumn("to", found).where("asks = 1")
    jump = landed_table(jump.select("key", (F.col("block") - 1).alias("block"), F.col("from").alias("entry"), "to"))
    longest = blocks.agg(F.max(F.col("block") - F.col("stretch"))).first()[0] or 0
    jumps, step = [], 1
    while step <= longest:
        jumps.append(jump)
        step *= 2
        if step <= longest:
            on = jump.select("key", (F.col("block") - step // 2).alias("block"), F.col("entry").alias("to"), F.col("to").alias("far"))
            jump = landed_table(jump.join(on, ["key", "block", "to"]).select("key", "block", "entry", F.col("far").alias("to")))
    reached = blocks.where(F.col("stretch") == F.col("block")).select("key", "block", F.col("low").alias("entry"))
    for number in reversed(range(len(jumps))):
        moved = reached.join(jumps[number], ["key", "block", "entry"])
        moved = moved.select("key", (F.col("block") + 2**number).alias("block"), F.col("to").alias("entry"))
        reached = landed_table(reached.unionByName(moved))
    return reached


def first_sights(rows: DataFrame, state: DataFrame, ttl_seconds: int = TTL_SECONDS, block: int = BLOCK) -> DataFrame:
    """Rows (key, micros, row_id) that no accepted row of their key precedes by at most ``ttl_seconds``.

    ``state`` has (key, last), the last row accepted before; rows up to a suppression behind it, and before it, are
    repeats. A suppressed row does not lengthen the suppression. Of rows with one key and time the least row_id counts.
    """
    shipped(rows.sparkSession)
    ttl, length = ttl_seconds * 1_000_000, ttl_seconds * 1_000_000 * block
    open_ = rows.join(state, "key", "left").where(F.col("last").isNull() | (F.col("micros") > F.col("last") + ttl))
    one = open_.groupBy("key", "micros").agg(F.min(F.struct("row_id")).alias("one")).select("key", "micros", "one.row_id")
    one = one.withColumn("into", F.pmod("micros", F.lit(length))).withColumn("block", F.expr(f"(micros - into) div {length}"))
    one = landed_table(one)
    # Only a key's blocks are ordered, never its rows. A block is on its own if the one before it has nothing in reach.
    spans = one.groupBy("key", "block").agg(F.min("into").alias("low"), F.max("into").alias("high"))
    along = Window.partitionBy("key").orderBy("block")
    reach = (F.lag("block").over(along) == F.col("block") - 1) & (F.lag("high").over(along) + ttl - length >= F.col("low"))
    spans = spans.withColumn("start", F.when(~F.coalesce(reach, F.lit(False)), F.col("block")))
    stretch = F.last("start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    blocks = landed_table(spans.select("key", "block", "low", stretch.alias("stretch")))
    linked = blocks.where(F.col("stretch") != F.col("block"))
    if not linked.isEmpty():
        chains = linked.select("key", "stretch").distinct()
        members = blocks.join(chains, ["key", "stretch"], "left_semi")
        entered = _entries(blocks, one.join(members.select("key", "block"), ["key", "block"], "left_semi"), ttl, length)
        blocks = blocks.join(entered, ["key", "block"], "left").withColumn("low", F.coalesce("entry", "low"))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Blocks(_groups(batch), batch["into"].to_numpy(), ttl, length)
        return batch.take(pa.array(found.taken(batch["low"].to_numpy()[found.first]))).select(["key", "micros", "row_id"])

    return _by_block(one.join(blocks.select("key", "block", "low"), ["key", "block"]), keep, one.select("key", "micros", "row_id").schema)


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def take_batch(
    batch: DataFrame, batch_id: int, sink: str, state: str, key: list[str], ts: str, row_id: str,
    lateness_seconds: int | None = None, ttl_seconds: int = TTL_SECONDS,
) -> None:
    """Take the rows of a batch in; a batch that runs again replaces what it wrote.

    With a lateness, the watermark is the greatest time so far less that. Rows up to it are settled: those accepted are written
    and their state goes. What stays in ``state`` is the rows behind the watermark, and the last accepted row of
    a key while it still suppresses. Batch n reads the state that batch n - 1 left and removes older ones. Rows at or before the
    watermark of the batches before come too late; they and rows without a time are put in the folder of rejects.

    Without a lateness all rows are only landed, and settled when they are read (``accepted``): files may then bring rows of
    any time, at the price of keeping all.
    """
    spark = batch.sparkSession
    narrow = batch.select(F.struct(*key).alias("key"), F.unix_micros(F.col(ts)).alias("micros"), F.col(row_id).alias("row_id"))
    narrow = reuse(narrow)
    if lateness_seconds is None:
        narrow.filter("micros IS NULL").select("key.*", "row_id").write.mode("overwrite").parquet(_folder(f"{sink}/rejects", batch_id))
        narrow.filter("micros IS NOT NULL").write.mode("overwrite").parquet(_folder(f"{sink}/rows", batch_id))
        narrow.unpersist()
        return
    ttl = ttl_seconds * 1_000_000
    open_, last, before = _state(spark, state, batch_id - 1, narrow)
    late = F.col("micros").isNull() if before is None else F.col("micros").isNull() | (F.col("micros") <= before)
    narrow.filter(late).select("key.*", "row_id").write.mode("overwrite").parquet(_folder(f"{sink}/rejects", batch_id))
    fresh = narrow.filter(~late)
    newest = fresh.agg(F.max("micros")).first()[0]
    marks = [m for m in (before, None if newest is None else newest - lateness_seconds * 1_000_000) if m is not None]
    mark = max(marks, default=None)
    waiting = open_.unionByName(fresh)
    settled = F.col("micros") <= F.lit(mark).cast("long")
    _folder_of = lambda name: _folder(f"{state}/{name}", batch_id)
    first_sights(waiting.filter(settled), last, ttl_seconds).write.mode("overwrite").parquet(_folder(f"{sink}/accepted", batch_id))
    done = spark.read.schema(narrow.schema).parquet(_folder(f"{sink}/accepted", batch_id))
    ahead = last.unionByName(done.select("key", F.col("micros").alias("last"))).groupBy("key").agg(F.max("last").alias("last"))
    ahead.filter(F.col("last") + ttl > F.lit(mark).cast("long")).write.mode("overwrite").parquet(_folder_of("last"))
    waiting.filter(~F.coalesce(settled, F.lit(False))).write.mode("overwrite").parquet(_folder_of("open"))
    spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(_folder_of("mark"))
    narrow.unpersist()
    for name in ("open", "last", "mark"):
        freed(spark, _folder(f"{state}/{name}", batch_id - 2))


def _state(spark: SparkSession, state: str, batch_id: int, like: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """The rows that wait, the last accepted ones and the watermark after a batch."""
    last = like.select("key", F.col("micros").alias("last"))
    if batch_id < 0:
        return like.limit(0), last.limit(0), None
    read = lambda name, schema: spark.read.schema(schema).parquet(_folder(f"{state}/{name}", batch_id))
    return read("open", like.schema), read("last", last.schema), read("mark", "mark long").first()[0]


def start_dedup(
    stream: DataFrame, sink: str, checkpoint: str, key: list[str], ts: str, row_id: str, lateness_seconds: int | None = None
) -> StreamingQuery:
    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, sink, f"{checkpoint}/rows", key, ts, row_id, lateness_seconds)

    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )


def accepted(spark: SparkSession, sink: str, ttl_seconds: int = TTL_SECONDS, checkpoint: str | None = None) -> DataFrame:
    """The accepted rows: the key's columns, accepted_at, row_id.

    With ``checkpoint``, what a stream with a lateness has settled, and what of its waiting rows would be accepted by now.
    Without, of a stream that only lands rows; the same however they came in batches.
    """
    if checkpoint is None:
        landed = spark.read.parquet(f"{sink}/rows").select("key", "micros", "row_id")
        rows = first_sights(landed, landed.select("key", F.col("micros").alias("last")).limit(0), ttl_seconds)
    else:
        newest = spark.read.parquet(f"{checkpoint}/rows/mark").agg(F.max("batch")).first()[0]
        settled = spark.read.parquet(f"{sink}/accepted").select("key", "micros", "row_id")
        open_, last, _ = _state(spark, f"{checkpoint}/rows", newest, settled)
        rows = settled.unionByName(first_sights(open_, last, ttl_seconds))
    return rows.select("key.*", F.timestamp_micros("micros").alias("accepted_at"), "row_id")
