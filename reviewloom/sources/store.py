"""The result store: a partitioned table of results, read back by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAINED = 50


def save(results: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Write results under their kind; writing one batch again replaces it.

    With ``batch_id`` the write overwrites just the partitions of that batch.
    """
    if batch_id is None:
        results.write.mode("append").partitionBy("kind").parquet(path)
        return
    (
        results.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "kind")
        .parquet(path)
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """The last saved result of each id: of the latest batch that has it.

    Each id's rows meet as partial maxima, one per task.  Two rows of one id in a batch are told apart by their values.
    """
    saved = spark.read.parquet(path)
    if "batch_id" not in saved.columns:
        return saved
    results = [c for c in saved.columns if c != "batch_id"]
    last = F.max_by(F.struct(*results), F.struct("batch_id", *sorted(set(results) - {"analysis_id"})))
    return saved.groupBy("analysis_id").agg(last.alias("last")).select("last.*")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Write what ``load`` gives as a table of its own, a folder per kind instead of one per batch."""
    save(load(spark, path), out)


def latest(saves: DataFrame, order: list[str]) -> DataFrame:
    """The last save of each id with the time of its first.

    ``saves`` has (analysis_id, saved_at, ...) and ``order``, the columns that put saves in
    sequence.  Both ends are aggregates that combine before the shuffle, so an id saved
    very often is no burden.
    """
    payload = [c for c in saves.columns if c not in ("analysis_id", *order)]
    return (
        saves.groupBy("analysis_id")
        .agg(
            F.min(F.struct(*order)).alias("first_save"),
            F.max_by(F.struct(*payload), F.struct(*order)).alias("last"),
            F.max(F.struct(*order)).alias("last_save"),
        )
        .select("analysis_id", "first_save", "last_save", "last.*")
    )


def retain_latest(saves: DataFrame, order: list[str], n: int = RETAINED) -> DataFrame:
    """Newest by first save: the ``n`` ids whose first save is newest; saving one again does not move it.

    Evictions are not replayed one by one, so an id saved again after it would have been dropped isn't new.
    """
    return latest(saves, order).orderBy(F.desc("first_save")).limit(n)


def lookup(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Each requested id with its result, and whether there is one."""
    found = results.withColumn("found", F.lit(True))
    return (
        requests.select("analysis_id")
        .distinct()
        .join(found, "analysis_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )
