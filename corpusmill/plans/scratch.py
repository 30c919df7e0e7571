"""Tables in the shared folder of the cluster, used to cut lineage and to keep state between jobs.

Every executor can read them, so a lost executor costs a task retry and nothing else. They lie in one folder for each
application, which is removed when the application's Python process ends; what later plans may still read is not
removed before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=None)
def _own(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusmill-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of this machine only where the session names none and is local (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own(spark.sparkContext.applicationId)
    return named.rstrip("/")


@lru_cache(maxsize=None)
def _root(spark: SparkSession, base: str, app: str) -> str:
    path = f"{base}/scratch-{app}-{uuid.uuid4().hex[:8]}"

    def remove() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is only scratch
            pass

    atexit.register(remove)
    return path


def new_path(spark: SparkSession, what: str) -> str:
    return f"{_root(spark, shared_folder(spark), spark.sparkContext.applicationId)}/{what}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "error", **options: str) -> DataFrame:
    df.write.mode(mode).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written once and read back: later plans start from the files."""
    return write_table(df, new_path(df.sparkSession, what))


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any URI that the cluster knows; a bare path is one of the default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = hadoop_path(spark, path)
    return files.exists(target)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that no later plan reads."""
    files, target = hadoop_path(spark, path)
    files.delete(target, True)
