"""Tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a session on one machine (master ``local[..]``), where it is unset, gets
    a temporary folder; on a cluster executors would not see one, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="ripple-")
        sc.setCheckpointDir(found)
    return found


_written: dict[str, SparkSession] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; this cuts its lineage.

    The tables go when the process ends, or with ``drop``, ``settled`` or ``drop_written``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ripple-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


class Growing:
    """A table in the shared folder that rows are added to."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        self.rows = written(rows, name)

    def add(self, more: DataFrame) -> None:
        more.select(*self.rows.columns).write.mode("append").parquet(_path_of[self.rows])
        grown = self.rows.sparkSession.read.schema(self.rows.schema).parquet(_path_of[self.rows])  # lists its files anew
        _path_of[grown] = _path_of.pop(self.rows)
        self.rows = grown


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, as a table; the tables that were written on the way to it are deleted."""
    before = set(_written)
    out = written(make(), name)
    for path in [p for p in _written if p not in before and p != _path_of[out]]:
        _delete(path)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``written`` returned, once all that reads it has been written itself."""
    path = _path_of.pop(df, None)
    if path in _written:
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written() -> None:
    """Delete the tables that ``written`` made in this process."""
    while _written:
        try:
            _delete(next(iter(_written)))
        except Exception:  # noqa: BLE001  the session has ended; nothing is left to ask
            return
