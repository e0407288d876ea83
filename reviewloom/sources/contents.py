"""Findings by content: a text that was scanned once is not scanned again, wherever it turns up.

A text goes by the hash of its bytes. The store has a row for every hash that a catalogue was run on, with all its findings.
A run hashes its texts, takes the hashes that the store doesn't have, one text of each, scans those, and adds them as a
batch; the results of all its files are then attached by hash. A changed catalogue has a folder of its own, so nothing
stale is read. A batch becomes visible when Spark commits it as a whole; one that was cut off is worked out again. Hashes
that two runs added at once count once.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from reviewloom.functions.rules import Rule
from reviewloom.operators import scan
from reviewloom.operators.joins import salted_join

STORED = f"hash binary, findings array<{scan.FINDING}>"


def catalogue_folder(path: str, pack: list[Rule]) -> str:
    """The folder of a catalogue: rules that find the same share one."""
    parts = [[r.rule_id, r.rule_ord, r.kind, r.type, r.level, r.java, list(r.pattern.needs), r.pattern.cut] for r in pack]
    return f"{path}/rules={hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]}"


def known(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, findings) of all contents that were scanned, each once."""
    try:
        rows = spark.read.schema(STORED).parquet(f"{folder}/batch=*")
    except AnalysisException:  # nothing was scanned yet
        return spark.createDataFrame([], STORED)
    return rows.groupBy("hash").agg(F.any_value("findings").alias("findings"))


def scan_new(files: DataFrame, pack: list[Rule], path: str, batch_id: int, text: str = "content") -> None:
    """Scan the contents of ``files`` that the store at ``path`` doesn't have; batch ``batch_id`` replaces itself.

    Null contents have no findings and are not stored.
    """
    spark, folder = files.sparkSession, catalogue_folder(path, pack)
    hashed = files.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(text, 256)).alias("hash"), F.col(text).alias("content"))
    # Of one content each task sends one copy.
    seen = known(spark, folder) if batch_id > 0 else spark.createDataFrame([], STORED)
    new = hashed.join(seen.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.any_value("content").alias("content"))
    found = new.select("hash", scan.findings_array("content", pack).alias("findings"))
    found.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def attached(files: DataFrame, pack: list[Rule], path: str, spread_by: str, text: str = "content") -> DataFrame:
    """One row per finding of ``files``, with their other columns, from the store: no text is scanned.

    A content that very many files share is joined in many tasks, by ``spread_by``, a column that tells files apart.
    """
    spark, keys = files.sparkSession, [c for c in files.columns if c != text]
    named = files.where(F.col(text).isNotNull()).select(*keys, F.unhex(F.sha2(text, 256)).alias("hash"))
    found = known(spark, catalogue_folder(path, pack)).where(F.size("findings") > 0)
    met = salted_join(found, named, ["hash"], spread_by)
    return met.select(*keys, F.inline("findings"))
