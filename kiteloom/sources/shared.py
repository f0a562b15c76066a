"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package's source to the Python workers of a session, once: they may start where it can't be imported."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="kiteloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/kiteloom.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/kiteloom.zip")
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, on one machine, a temporary folder of this process.

    On a cluster there is no such stand-in: executors would write where nobody else can read.
    """
    for get in (spark.conf.get, spark.sparkContext.getConf().get):
        if found := get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="kiteloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, nothing being there yet."""
    return f"{shared_dir(spark)}/kiteloom/{name}-{uuid.uuid4().hex}"


def deleted_at_exit(spark: SparkSession, path: str) -> str:
    """Says that what has been written to ``path`` goes when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, **options: str) -> str:
    """Writes ``df`` as Parquet into the shared folder, under a name of its own. The files go when the driver's JVM ends."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return deleted_at_exit(df.sparkSession, path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and values drawn once stay."""
    spark, path = df.sparkSession, written(df, name)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)
