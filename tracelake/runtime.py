"""Session-level services shared by every module: sessions, code shipping and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: int | str = "*", name: str = "tracelake", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRACELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers unpickle operator functions by module name, so every executor needs the package even where it
    is not installed. ``addPyFile`` distributes a zip through Spark's own file service; no shared disk is assumed.
    """
    # Arrow batches of few rows keep the workers' memory bounded when single texts are very long; a number that the
    # caller has set stays
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tracelake-"))
    path = os.path.join(folder, "tracelake_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("tracelake", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    Read from ``spark.checkpoint.dir``. Where it is unset, a local master (tests, bench) gets a folder of its own; on a
    cluster there is none that all machines share, and that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor, and go when the
    application ends.

    ``keep`` writes a DataFrame as zstd Parquet and returns it reread; ``drop`` deletes one table early, which an
    iterative plan does as soon as the next table is complete.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tracelake-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._told = False

    def _files(self, path: str):
        """The path and its file system, as the driver's Hadoop classes see them."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        where = self.path(label)
        df.write.option("compression", "zstd").parquet(where)
        if not self._told:  # only a folder that exists can be marked for the end
            root, files = self._files(self.root)
            self._told = files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tracelake_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        where = getattr(df, "_tracelake_path", None)
        if where:
            path, files = self._files(where)
            files.delete(path, True)


#: Largest side that is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if the optimiser knows its size and that is small; else as it is."""
    n = input_bytes(df)
    return F.broadcast(df) if 0 < n <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Estimates from here on mean that the optimiser knows nothing of a plan's size.
UNKNOWN_BYTES = 1 << 55


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate for a plan, used only to choose partition counts; 0 if it has none, so that the
    session's own number of shuffle partitions holds."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < UNKNOWN_BYTES else 0


def parts_for(n_bytes: int, per_part: int, least: int = 8, most: int = 200_000) -> int:
    """How many partitions hold ``n_bytes`` at ``per_part`` bytes each."""
    return max(least, min(most, -(-n_bytes // per_part)))
