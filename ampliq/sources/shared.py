"""The folder that driver and executors share, and tables that are written to it."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000
_written: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is
    made and set as its checkpoint folder; it goes when Python ends.  A cluster
    must name one: RuntimeError otherwise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="ampliq-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _path(spark: SparkSession, folder: str) -> tuple:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _path(spark, folder)
    return system.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


def _stamp(spark: SparkSession, folder: str) -> str:
    """Changes when a table of ``folder``, or a file of one, is written: names and times of both, one listing a table."""
    system, path = _path(spark, folder)
    if not system.exists(path):
        return ""
    tables = list(system.listStatus(path))
    files = [f for t in tables for f in ([t] if t.isFile() else system.listStatus(t.getPath()))]
    return hashlib.sha256(repr(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in files)).encode()).hexdigest()


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written as Parquet once per session and input; again if that folder was cleared or a table in ``sf_dir`` was written since."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name} {_stamp(spark, sf_dir)}")
    if key not in _written or not exists(spark, f"{_written[key]}/_SUCCESS"):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def written(table: DataFrame, name: str) -> DataFrame:
    """``table``, written as Parquet to the shared folder and read again: what follows doesn't change how it is computed."""
    path = f"{shared_dir(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows; larger ones are joined as Spark plans it."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
