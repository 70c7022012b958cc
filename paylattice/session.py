"""Session settings and the shared folder used for checkpoints and written stages."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime SQL settings the operators count on. Shuffle width, file split size and the
# broadcast threshold are left to the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where that costs one more exchange after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # percentile digests of so many groups stay in the hash map before Spark falls back to a sort;
    # a full digest takes about half a megabyte, so this is at most half a gigabyte per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(package.rglob("*.py")):
            file.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="paylattice-")
    return _local_dirs[context.applicationId]


def stage_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; safe to delete once the application has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting that holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries that end inside the block are freed at once, not when the driver collects garbage."""
    return setting(spark, _CLEANUP, "true")


@contextmanager
def collected(spark: SparkSession, every: float = 10.0) -> Iterator[None]:
    """The driver collects garbage every so many seconds and at the end of the block.

    Spark frees the shuffle files of RDD jobs when the driver has found that nothing refers to them; a driver with
    memory to spare may not look for hours.
    """
    ended = threading.Event()

    def collect() -> None:
        while not ended.wait(every):
            spark.sparkContext._jvm.System.gc()

    worker = threading.Thread(target=collect, daemon=True)
    worker.start()
    try:
        yield
    finally:
        ended.set()
        worker.join()
        spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, schema: StructType | None = None, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    Lost executors cannot undo the work, later steps see one fixed split of the rows, and
    Catalyst plans with the true size of the table. `schema` reads them back under other types. A table
    that is already at `path` is replaced, so it must not be read any more.
    """
    spark = df.sparkSession
    path = path or f"{stage_dir(spark)}/cut/{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
