"""What the operators share: reading, cutting lineage, byte buffers of a batch, a hash index."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, so that long texts don't pile up in a Python worker.
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """The session, ready for the operators: workers can import them, and Arrow batches have a bound in bytes."""
    if getattr(spark.sparkContext, "_llm_sent", None) is None:
        spark.sparkContext._llm_sent = True
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="llm-code-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as file:
            for module in sorted(package.rglob("*.py")):
                file.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))  # Spark sends it to every executor
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared one; it goes when the driver's JVM ends.

    Where ``spark.checkpoint.dir`` is unset, only a local session gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    folder = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read again: its lineage ends there."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def draw_order(max_bytes: int) -> list[Column]:
    """The order in which documents (doc_id, bytes) are drawn for learning: by a hash of the id, those that alone are
    above ``max_bytes`` after all others, the smallest of them first."""
    number = F.xxhash64("doc_id")
    return [F.greatest("bytes", F.lit(max_bytes).cast("long")), F.pmod(number, F.lit(1 << 20)), number, F.col("doc_id")]


def text_digest(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column | str, digest: Column | str) -> dict[str, Column]:
    """``__rid`` and ``__th``, which tell rows apart that differ in id or text (its ``digest``); never null."""
    number = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long")
    return {
        "__rid": F.coalesce(number, F.xxhash64(F.lit("no id"), digest)),
        "__th": F.shiftright(digest, 32).cast("int"),
    }


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the offsets of its n rows (n + 1).

    Null is empty. The bytes are those of the batch, not a copy, where it has no null.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(ends) == 0:
        ends = np.zeros(1, dtype=np.int64)
    first, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - first


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


class Index:
    """Positions of distinct uint64 keys, found by open addressing over whole arrays."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last one gets the slot
            rest = self.slots[at] != todo
            todo, at = todo[rest], (at[rest] + 1) & self.mask
        self.stored = np.zeros(len(self.slots), dtype=np.uint64)
        used = self.slots >= 0
        self.stored[used] = self.keys[self.slots[used]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it isn't there."""
        at = self._home(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.stored[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found[wrong] = self.slots[at]
            on = (self.slots[at] >= 0) & (self.stored[at] != keys[wrong])
            wrong, at = wrong[on], at[on]
        return found
