"""Sessions, and how the package reaches Python workers on other machines."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch. Texts are kilobytes each, so this bounds what a Python worker and its task hold at once.
ARROW_ROWS = "1000"
#: And its bytes, where texts are longer than that.
ARROW_BYTES = "4m"


def build(app: str = "tidewright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution, and skewed joins split at run time."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of all workers, once a Spark application (the driver serves the archive), and sets
    the size of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="tidewright-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


_written: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where none is set and all runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-checkpoint-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Shuffle files go when the query that made them ends; what is written is reread from its table, never made again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and rereads it: the lineage ends there and an executor that is
    lost takes nothing with it. The files go with `passing` or `discard`, or else when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if not _written:
        atexit.register(_drop_written)  # now, so that it runs before Spark's own end
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


class passing:
    """Of the tables written inside the block, only those given to keep() are still there after it. What was read from the
    others must be written by then; a block that fails leaves all to the driver's end."""

    def __enter__(self) -> passing:
        self.before, self.kept = set(_written), set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._tidewright_path)
        return df

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            for path in set(_written) - self.before - self.kept:
                _drop(path, _written.pop(path))


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables, once nothing reads them any more."""
    for df in tables:
        path = df._tidewright_path
        if path in _written:
            _drop(path, _written.pop(path))


def _drop(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_written() -> None:
    for path, spark in _written.items():
        try:
            _drop(path, spark)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
