"""Intermediate tables in the folder that all executors share.

An iterative operator cuts its lineage by writing a table and reading it
back. The tables go below ``spark.checkpoint.dir`` of the session, so a lost
executor costs only the tasks it ran. They are removed when the driver exits,
or by ``drop`` and ``settled`` once nothing reads them.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: dict[str, SparkSession] = {}
_open: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[sc.applicationId]


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/barloom-{spark.sparkContext.applicationId}"
    if home not in _used:
        _used[home] = spark
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark drops shuffle files when the driver collects what points to them; a plan of many steps should not wait
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    if _open:
        _open[-1].append(table)
    return table


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written; what it wrote on the way is deleted."""
    _open.append([])
    try:
        result = build()
        mine = _open.pop()
    except BaseException:
        _open.pop()
        raise
    table = keep(result)
    drop(*mine)
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned; nothing may read them any more."""
    for table in tables:
        _delete(table.sparkSession, table.kept_at)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear() -> None:
    for home, spark in _used.items():
        try:
            _delete(spark, home)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


atexit.register(_clear)
