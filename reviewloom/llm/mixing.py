"""Mixing sources to target weights by a low-discrepancy schedule.

A document's size is its number of words. The sources, by code point with null last, weigh 3, 1, 2 and so on, and share
``budget`` times all sizes; a target stops at ``epochs`` times the source's size, and the excess is shared
anew by weight until no target is above that.

The schedule is a row of slots of ``BLOCK`` words. Slot i lies at the golden-ratio point frac((i + 1/2) * 0.618..), which
falls into one source's part of the cumulative targets; any run of slots so holds every source near
its share. The slots of a source are ranked. Its documents, shuffled by a hash of their ids, lie end to end, twice, and are
cut into blocks of ``BLOCK`` words; slot rank r takes block r. Both sides meet on (source, rank).

Ranks and places are sums in two steps (within a chunk, over the chunks), so no task sees a whole source. Null text has size
0; a document of size 0 takes nothing. Rows that are alike in everything are interchangeable. Reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, row_key, text_digest, written

WEIGHTS, BUDGET, EPOCHS = (3, 1, 2), 1.5, 2
BLOCK = 64
#: Slots of a chunk, and cells of the line that points are looked up in.
CHUNK, CELLS = 65_536, 1024
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """sid (1, 2, ..), source, source_size, target, lo, hi: a row for each source of ``sizes`` (source, size).

    The windows without a partition run over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.Window.partitionBy().rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order))
    weight = F.array(*map(F.lit, weights))[((F.col("sid") - 1) % len(weights)).cast("int")]
    per = per.withColumns(
        {"weight": weight.cast("double"), "top": (epochs * F.col("source_size")).cast("double")}
    ).withColumn("fill", F.col("top") / F.col("weight"))
    # Sources stop at their top in order of ``fill``: the level is where what is left fits.
    rising = W.Window.orderBy("fill", "sid")
    before, after = rising.rowsBetween(W.Window.unboundedPreceding, -1), rising.rowsBetween(0, W.Window.unboundedFollowing)
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every)
    per = per.withColumn("target", F.least(F.coalesce(level, F.col("fill")) * F.col("weight"), F.col("top")))
    total = F.sum("target").over(every)
    upto = F.sum("target").over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    per = per.withColumns({"hi": F.try_divide(upto, total), "total": total})
    lo = F.coalesce(F.lag("hi").over(order), F.lit(0.0))
    return per.select("sid", "source", "source_size", "target", lo.alias("lo"), "hi", "total")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank): the source of every slot, and which of that source's slots it is."""
    spark = sources.sparkSession
    total = sources.agg(F.max("total")).first()[0] or 0.0
    slots = spark.range(int(-(-total // block))).select(F.col("id").alias("slot"))
    slots = slots.withColumn("point", ((F.col("slot") + 0.5) * GOLDEN) % F.lit(1.0))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    cut = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = sources.where("target > 0").select(
        "sid", "lo", "hi", F.explode(F.sequence(cut("lo"), cut("hi"))).alias("cell")
    )
    at = slots.join(cells, "cell").where("point >= lo AND point < hi")
    at = at.select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    per = at.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    over = W.Window.partitionBy("sid").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    per = per.select("sid", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = at.withColumn("rank", F.row_number().over(within) - 1).join(per, ["sid", "chunk"])
    return ranked.select("slot", "sid", (F.col("base") + F.col("rank")).alias("rank"))


def places(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with sid, source_size, target and ``start``, the words of the source before the document."""
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    per = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    over = W.Window.partitionBy("sid").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    per = per.select("sid", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    within = (
        W.Window.partitionBy("sid", "bucket")
        .orderBy("key", "size", "text_hash")
        .rowsBetween(W.Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("ahead", F.sum("size").over(within) - F.col("size")).join(per, ["sid", "bucket"])
    return rows.withColumn("start", F.col("base") + F.col("ahead"))


def blocks(placed: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """(sid, start, turn, rank, words): what each document gives to the blocks of its source, in each turn."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("turn")
    laid = placed.where("size > 0").select("sid", "start", "size", "source_size", turn)
    laid = laid.withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
    laid = laid.withColumn("to", F.col("from") + F.col("size"))
    first, last = F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)
    laid = laid.select("sid", "start", "turn", "from", "to", F.explode(F.sequence(first, last)).alias("rank"))
    words = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    return laid.select("sid", "start", "turn", "rank", words.alias("words"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash of every row; the texts are read once."""
    bounded(docs.sparkSession)
    return written(
        docs.select(
            F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), text_digest("text").alias("text_hash")
        )
    )


def mix(sizes: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (of ``sized``) with source_size, target, taken and taken_by_turn (a number for each turn)."""
    sources = written(targets(sizes, epochs=epochs))
    placed = written(places(sizes, sources))
    met = blocks(placed, block, epochs).join(schedule(sources, block), ["sid", "rank"])
    turns = [f"__turn{n}" for n in range(epochs)]
    sums = [F.sum(F.when(F.col("turn") == n, F.col("words"))).alias(name) for n, name in enumerate(turns)]
    taken = met.groupBy("sid", "start").agg(*sums)
    # Documents without words share a place with the next one, but take nothing.
    got = [F.when(F.col("size") > 0, F.coalesce(name, F.lit(0))).otherwise(F.lit(0)).cast("long") for name in turns]
    return placed.join(taken, ["sid", "start"], "left").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        reduce(Column.__add__, got).alias("taken"), F.array(*got).alias("taken_by_turn"),
    )


def mixed(docs: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """The documents in the mix, all columns, with size, source_size, target, taken and taken_by_turn.

    A document that has words of which none is taken goes; one without words stays. Columns of the new names are replaced.
    """
    new = ["size", "source_size", "target", "taken", "taken_by_turn"]
    copy = F.row_number().over(W.Window.partitionBy("__rid", "__th").orderBy("__source"))
    part = mix(sized(docs), block, epochs).withColumns(row_key("doc_id", "text_hash")).withColumnRenamed("source", "__source")
    part = part.withColumn("__copy", copy).where("size = 0 OR taken > 0").select("__rid", "__th", "__copy", *new)
    names = [n for n in docs.columns if n not in new]
    rows = docs.select(*names).withColumns(row_key("doc_id", text_digest("text")) | {"__source": F.col("source")})
    rows = rows.withColumn("__copy", copy)
    return rows.join(part, ["__rid", "__th", "__copy"]).select(*names, *new)


def mix_sql() -> str:
    """The same in DuckDB, in plain windows over whole sources."""
    weights = "CASE (sid - 1) % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END"
    return f"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
per AS (
  SELECT source, sid, source_size, {weights} AS weight, 2.0::double * source_size AS top
  FROM (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes GROUP BY source)),
-- Share what is left among those below their top, again and again.
rounds AS (
  SELECT 0 AS n, sid, weight, top, source_size, 0.0::double AS target, false AS stopped FROM per
  UNION ALL
  SELECT n + 1, sid, weight, top, source_size, least(share, top), stopped OR share >= top
  FROM (SELECT *, CASE WHEN stopped THEN top ELSE weight * (1.5::double * sum(source_size) OVER () - coalesce(sum(top) FILTER (stopped) OVER (), 0))
                       / sum(weight) FILTER (NOT stopped) OVER () END AS share FROM rounds)
  WHERE n < 60),
target AS (SELECT sid, target FROM rounds WHERE n = 60),
line AS (
  SELECT p.sid, p.source, p.source_size, t.target, sum(t.target) OVER (ORDER BY p.sid) AS hi, sum(t.target) OVER () AS total
  FROM per p JOIN target t USING (sid)),
cuts AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0.0::double) / total AS lo, hi / total AS up FROM line),
slots AS (
  SELECT i, ((i + 0.5::double) * {GOLDEN!r}::double) % 1.0::double AS point
  FROM range((SELECT ceil(max(total) / {BLOCK})::bigint FROM cuts)) r(i)),
counts AS (SELECT sid, count(*) AS n FROM slots JOIN cuts ON point >= lo AND point < up GROUP BY sid),
placed AS (
  SELECT s.doc_id, s.size, c.sid, c.source_size, c.target, coalesce(n, 0) * {BLOCK} AS reach,
         sum(s.size) OVER (PARTITION BY c.sid ORDER BY md5(s.doc_id::varchar), s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sizes s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source LEFT JOIN counts USING (sid))
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - source_size - start)))::bigint AS taken
FROM placed"""
