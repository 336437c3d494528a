"""Session settings, and the two ways of cutting lineage that survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sparkir") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    shared_dir(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they can import it wherever they start."""
    sc = spark.sparkContext
    if _shipped.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparkir-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "sparkir_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))  # Spark's file server hands it to the executors
    _shipped["app"] = sc.applicationId


_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables: the one that spark.checkpoint.dir names.

    Where it is unset a RuntimeError says so, but for sessions of one process (local, local[n]), as tests have them: only
    those get a folder of their own, which is removed when the process ends."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sparkir-one-process-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; later readers do not compute it again.

    Its joins are sort-merge joins unless the caller broadcasts a side, as for `stage`."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True).hint("merge")


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """What is written here frees its shuffle files when it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_KEY, None)
    spark.conf.set(FREE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_KEY) if before is None else spark.conf.set(FREE_KEY, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as a Parquet table in the shared folder: columns stay prunable, unlike with a checkpoint.

    The table grows with the records, and its compressed size says little about its size in memory, so it carries the hint
    of a sort-merge join: Spark does not broadcast it by itself. F.broadcast around it takes precedence.
    It is kept until the driver's Python ends or `drop_stages` is called, as plans may read it any time."""
    spark = df.sparkSession
    path = f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what `stage` wrote, given what it returned, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Deletes the tables that this application's `stage` calls wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_stages(spark)
        except Exception:  # noqa: BLE001  the session has ended before
            pass
