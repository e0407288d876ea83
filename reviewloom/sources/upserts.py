"""The result store as a map from id to last result: bucketed snapshots, deltas, and a manifest.

An id's bucket is the top bits of its hash, and files are ranges of the hash inside a bucket.  A save writes a
delta, one row per id, and commits by putting the next manifest in place, which fails if another writer was
first.  A manifest names the snapshot folder of each bucket and the deltas since, so what a save wrote before it
broke off is never read.  Compaction merges deltas into the buckets they touch; the others stay as they lie.

A read leaves out of the snapshots the ids that a delta has: history is not regrouped, only the deltas are.
Beside each folder lies a list of its files with their ranges of hashes, by which a batch of ids finds the
few files it has to open.

A null id is an id like any other.  Of rows alike in id and order the one with the greatest values is kept.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewloom.session import _path, freed

ID = "analysis_id"
# Columns of the store's own; results may not have them.
SEQ, HASH, BUCKET, COMMIT = "store_seq", "store_hash", "store_bucket", "store_commit"
BUCKET_BITS = 6
# Up to so many files are opened by name; the list of them is all that the driver gets.
POINT_FILES = 10_000


@dataclass
class Manifest:
    """What a committed state of the store consists of; its size goes with buckets and open deltas."""

    number: int = 0
    bits: int = BUCKET_BITS
    schema: str = ""
    batch_id: int | None = None
    snapshots: dict[str, str] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)

    def stored(self) -> StructType:
        found = StructType.fromJson(json.loads(self.schema))
        return found.add(SEQ, "long").add(HASH, "long").add(COMMIT, "string").add(BUCKET, "integer")

    def folders(self) -> set[str]:
        return {*self.snapshots.values(), *self.deltas}


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _path(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != ".")


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest:
    """The last committed manifest, or that of ``number``; an empty one for a store without saves."""
    numbers = _numbers(spark, path)
    if number is None and not numbers:
        return Manifest()
    name = f"{path}/manifests/{numbers[-1] if number is None else number:012d}.json"
    return Manifest(**json.loads(spark.read.text(name, wholetext=True).first()[0]))


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Put a whole manifest in place under its number; if that is taken, nothing changes and an error says so."""
    jvm = spark._jvm
    final, files = _path(spark, f"{path}/manifests/{new.number:012d}.json")
    draft, _ = _path(spark, f"{path}/manifests/.{uuid.uuid4()}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if files.exists(final):
        files.delete(draft, False)
        raise FileExistsError(f"another writer committed {new.number} to {path}; save again")
    context.rename(files.makeQualified(draft), files.makeQualified(final), none)


def _write(rows: DataFrame, path: str, bits: int) -> str:
    """Rows as files of hash ranges, buckets as folders, with the list of files and their ranges beside them."""
    name = str(uuid.uuid4())
    folder = f"{path}/data/{COMMIT}={name}"
    bucket = F.shiftrightunsigned(HASH, 64 - bits).cast("int")
    placed = rows.withColumn(HASH, F.xxhash64(ID)).withColumn(BUCKET, bucket)
    (
        placed.repartitionByRange(BUCKET, HASH)
        .sortWithinPartitions(BUCKET, HASH)
        .write.option(f"parquet.bloom.filter.enabled#{ID}", "true")
        .partitionBy(BUCKET)
        .parquet(folder)
    )
    written = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    ranges = written.groupBy(BUCKET, F.col("_metadata.file_path").alias("file")).agg(
        F.min(HASH).alias("low"), F.max(HASH).alias("high"), F.count(F.lit(1)).alias("n_ids")
    )
    ranges.write.parquet(f"{path}/files/{COMMIT}={name}")
    return name


def _last(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per id, the greatest by ``by`` and then by the values; combined before the shuffle."""
    rest = [c for c in rows.columns if c != ID]
    rank = F.struct(*by, *[c for c in rest if c not in by])
    return rows.groupBy(ID).agg(F.max_by(F.struct(*rest), rank).alias("last")).select(ID, "last.*")


def upsert(results: DataFrame, path: str, order: list[str], batch_id: int | None = None, bits: int = BUCKET_BITS) -> bool:
    """Save results, the last of each id by ``order``; whatever an earlier save had for these ids is replaced.

    The first save of a store gives it two to the ``bits`` buckets (one bit at least).

    A batch whose ``batch_id`` is not above that of the last save is one replayed: nothing is written, and the result is False.
    """
    spark = results.sparkSession
    old = manifest(spark, path)
    if batch_id is not None and old.batch_id is not None and batch_id <= old.batch_id:
        return False
    if old.schema and results.dtypes != [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(old.schema))]:
        raise ValueError(f"the store has other columns: {old.stored().simpleString()}")
    if not old.schema:
        old.bits = max(bits, 1)
    number = old.number + 1
    rows = _last(results, order).select(*results.columns).withColumn(SEQ, F.lit(number).cast("long"))
    name = _write(rows, path, old.bits)
    new = Manifest(
        number, old.bits, results.schema.json(), old.batch_id if batch_id is None else batch_id,
        old.snapshots, [*old.deltas, name],
    )
    _commit(spark, path, new)
    return True


def _folders(path: str, found: Manifest) -> list[str]:
    """Folders of the snapshots, one per bucket."""
    return [f"{path}/data/{COMMIT}={name}/{BUCKET}={bucket}" for bucket, name in sorted(found.snapshots.items())]


def _rows(spark: SparkSession, path: str, found: Manifest, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], found.stored())
    return spark.read.schema(found.stored()).option("basePath", f"{path}/data").parquet(*folders)


def _merged(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Snapshot rows whose id no delta has, and the last row of each id in the deltas."""
    changed = deltas.select(F.col(ID).alias("changed_id"), F.col(BUCKET).alias("changed_in")).distinct()
    same = (F.col(BUCKET) == F.col("changed_in")) & F.col(ID).eqNullSafe(F.col("changed_id"))
    return base.join(changed, same, "left_anti").unionByName(_last(deltas, [SEQ]))


def _state(spark: SparkSession, path: str, number: int | None) -> Manifest:
    found = manifest(spark, path, number)
    if not found.schema:
        raise FileNotFoundError(f"no results were saved to {path}")
    return found


def _whole(spark: SparkSession, path: str, found: Manifest) -> DataFrame:
    base = _rows(spark, path, found, _folders(path, found))
    if not found.deltas:
        return base
    return _merged(base, _rows(spark, path, found, [f"{path}/data/{COMMIT}={name}" for name in found.deltas]))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Each id's last result, as of the last commit or of that of ``number``."""
    return _whole(spark, path, _state(spark, path, number)).drop(SEQ, HASH, BUCKET, COMMIT)


def _lists(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Files of the given folders with their ranges of hashes."""
    ranges = f"{BUCKET} int, file string, low long, high long, n_ids long, {COMMIT} string"
    return spark.read.schema(ranges).option("basePath", f"{path}/files").parquet(*folders)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the deltas into the buckets they touch; the snapshots of other buckets stay as they are."""
    found = _state(spark, path, None)
    if not found.deltas:
        return
    lists = _lists(spark, path, [f"{path}/files/{COMMIT}={name}" for name in found.deltas])
    touched = [row[0] for row in lists.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
    rows = _whole(spark, path, found).where(F.col(BUCKET).isin(touched)).drop(HASH, BUCKET, COMMIT)
    name = _write(rows, path, found.bits)
    snapshots = found.snapshots | {str(bucket): name for bucket in touched}
    _commit(spark, path, Manifest(found.number + 1, found.bits, found.schema, found.batch_id, snapshots, []))


def _candidates(ids: DataFrame, path: str, found: Manifest) -> DataFrame:
    """Files whose range of hashes has that of a wanted id, in the snapshots and in the deltas."""
    spark = ids.sparkSession
    lists = _lists(spark, path, [f"{path}/files/{COMMIT}={name}" for name in sorted(found.folders())])
    # An old folder may hold some buckets whose snapshot a later one replaced.
    current = F.col(COMMIT).isin(found.deltas)
    for bucket, name in found.snapshots.items():
        current = current | ((F.col(BUCKET) == int(bucket)) & (F.col(COMMIT) == name))
    lists = lists.where(current)
    hashed = ids.select(F.xxhash64(ID).alias("wanted")).distinct()
    wanted = hashed.withColumn(BUCKET, F.shiftrightunsigned("wanted", 64 - found.bits).cast("int"))
    return lists.join(wanted, BUCKET).where(F.col("wanted").between(F.col("low"), F.col("high"))).select("file").distinct()


def get(ids: DataFrame, path: str, most_files: int = POINT_FILES) -> DataFrame:
    """Each requested id once, with its last result and whether there is one.

    Only files that can have an id are opened, while they are few; for more of them, the whole store is joined, with the same rows.
    """
    spark = ids.sparkSession
    found = _state(spark, path, None)
    wanted = ids.select(F.col(ID).alias("wanted_id")).distinct()
    files = [row[0] for row in _candidates(ids, path, found).limit(most_files + 1).collect()]
    if len(files) > most_files:
        rows = _whole(spark, path, found)
    else:
        # A later save has the greater number, so the last row of an id needs no other files.
        rows = _last(_rows(spark, path, found, files), [SEQ])
    rows = rows.drop(SEQ, HASH, BUCKET, COMMIT).withColumn("found", F.lit(True))
    met = wanted.join(rows, F.col("wanted_id").eqNullSafe(F.col(ID)), "left")
    return met.withColumns({ID: F.col("wanted_id"), "found": F.coalesce("found", F.lit(False))}).drop("wanted_id")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove folders that none of the last ``keep`` manifests names, and say how many; no writer may run meanwhile.

    Older manifests go too, so ``read`` knows their numbers no more.
    """
    numbers = _numbers(spark, path)
    used = set().union(*[manifest(spark, path, n).folders() for n in numbers[-keep:]])
    for number in numbers[:-keep]:
        freed(spark, f"{path}/manifests/{number:012d}.json")
    folder, files = _path(spark, f"{path}/data")
    names = [status.getPath().getName().removeprefix(f"{COMMIT}=") for status in files.listStatus(folder)]
    unused = [name for name in names if name not in used]
    for name in unused:
        freed(spark, f"{path}/data/{COMMIT}={name}")
        freed(spark, f"{path}/files/{COMMIT}={name}")
    return len(unused)
