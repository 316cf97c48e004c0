"""Tables that are made once from a version of their inputs and then read by every query of the session."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only on a single machine that
    names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return spark.conf.get("spark.checkpoint.dir")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder there, which goes when the driver's process ends."""
    path = f"{root(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is temporary anyway
        pass


def version(spark: SparkSession, *paths: str) -> str:
    """Changes when an input gets another number of files or bytes, or another time of change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    said = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        size, status = fs.getContentSummary(p), fs.getFileStatus(p)
        said.append((path, size.getFileCount(), size.getLength(), status.getModificationTime()))
    return hashlib.sha256(repr(said).encode()).hexdigest()


def place(spark: SparkSession, name: str, inputs: list[str], make: Callable[[str], None]) -> str:
    """The folder that make(folder) filled for this version of the inputs; filled at first call."""
    key = (spark.sparkContext.applicationId, name, version(spark, *inputs))
    if key not in _made:
        path = folder(spark, name)
        make(path)
        _made[key] = path
    return _made[key]


def table(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written once for this version of the inputs."""
    return spark.read.parquet(place(spark, name, inputs, lambda path: make().write.parquet(path)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df's rows, computed now and once, for a result that several parts of a plan read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Makes all anew at their next use."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        delete(spark, _made.pop(key))
