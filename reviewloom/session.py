"""Session settings, the shared folder of streams, and reuse of scans."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: str | int = "*", name: str = "reviewloom", settings: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every expression takes longer than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, for streams.

    A cluster names it in ``spark.checkpoint.dir``; only a local session may go without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def reuse(df: DataFrame) -> DataFrame:
    """Keep what an expensive scan gives for its second reader, in the executors.

    Nothing runs before the result is asked for, and what a lost executor kept is worked out anew.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as Spark's file sources write its name, without a slash at its end."""
    path, files = _path(spark, folder)
    return files.makeQualified(path).toString().rstrip("/")


@contextmanager
def listed_in_lots(spark: SparkSession) -> Iterator[None]:
    """Loads in here list their folders in a few lots for each core; Spark makes a task of each folder, up to thousands."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one; it goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4()}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def landed_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def freed(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this library wrote and needs no more; one that isn't there is no error."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers can import this package; Spark sends it to every executor, once."""
    if getattr(spark.sparkContext, "_package_sent", None) is None:
        spark.sparkContext._package_sent = True
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="code-"), f"{package.name}-core.zip")
        with zipfile.ZipFile(archive, "w") as file:
            for module in sorted(package.rglob("*.py")):
                file.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
    return spark
