"""Session helpers: defaults for local use and the shared folder for cut points."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(app: str = "chronoloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application.

    Executors need no copy of the repository: the sources travel as one zip file.
    """
    context = spark.sparkContext
    if getattr(context, "_chronoloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="chronoloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    place = os.path.join(folder, "chronoloom.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("chronoloom", os.path.relpath(path, root)))
    context.addPyFile(place)
    context._chronoloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests, benches) gets a temporary folder, remembered in the
    session. On a cluster a folder of one machine would lose what other machines write: an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """Have the driver's JVM delete *path* when it ends, unless :func:`drop` does before."""
    files, place = _hadoop(spark, path)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage of *df*: write it as a table in the shared folder and read it back.

    A written table survives the loss of any executor, is columnar and compressed, and gives the
    optimizer true sizes. The table is deleted by :func:`drop` when a later one supersedes it, else
    when the application ends, since the frames made from it are evaluated lazily.
    """
    return counted_cut(df, label)[0]


def counted_cut(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`cut`, with aggregates over the rows that are counted while they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    kept_until_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path  # type: ignore[attr-defined]
    return back, seen.get if metrics else {}


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`cut`; other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    files, place = _hadoop(df.sparkSession, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)
