"""Session, table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import py_compile
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster spark-submit sets these."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: functions on Arrow batches import it there.

    The archive holds sources and compiled code, so that new Python workers need not compile."""
    context = spark.sparkContext
    if getattr(context, "_eventloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="eventloom-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "eventloom.zip", "w") as archive:
        for source in sorted(package.rglob("*.py")):
            name = Path("eventloom", source.relative_to(package))
            archive.write(source, name)
            compiled = py_compile.compile(str(source), str(folder / "code.pyc"), dfile=str(name), invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
            archive.write(compiled, name.with_suffix(".pyc"))
    context.addPyFile(str(folder / "eventloom.zip"))
    context._eventloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; Parquet's own statistics and column pruning apply."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster has no such fallback, since its
    executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = getattr(spark, "_eventloom_folder", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    holder = tempfile.TemporaryDirectory(prefix="eventloom-")
    atexit.register(holder.cleanup)
    spark._eventloom_folder = f"file://{holder.name}"
    return spark._eventloom_folder


class Stages:
    """Intermediate tables of one operator, written once to the shared folder so that later steps read
    them instead of recomputing, and so that a lost executor costs no lineage.

    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_folder(spark)}/eventloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if not _ROOTS:
            atexit.register(_clean)
        _ROOTS.append(self)

    def write(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.root}/{self.count:03d}"
        self.count += 1
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._eventloom_path = path
        return kept

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_eventloom_path", None)
        if path:
            self._delete(path)

    def keep(self, *frames: DataFrame) -> None:
        """Drops all tables but these, once they hold what a result still reads."""
        kept = {getattr(df, "_eventloom_path", None) for df in frames}
        for i in range(self.count):
            if (path := f"{self.root}/{i:03d}") not in kept:
                self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_ROOTS: list[Stages] = []


def _clean() -> None:
    """Removes what this driver's operators wrote; results are lazy, so not before it ends."""
    for stages in _ROOTS:
        try:
            stages._delete(stages.root)
        except Exception:  # the session is gone: its folder is the cluster's to clear
            return
