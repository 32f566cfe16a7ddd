"""Session factory and shared-folder tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "larkspur", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC timestamps and Arrow transfer."""
    n = cpus or os.cpu_count() or 8
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers find the package from any folder
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH"))))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode a temporary one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders of written tables that are still there, with the session and the thread that wrote them.
_TABLES: dict[str, tuple[SparkSession, int]] = {}


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: the lineage ends there, no executor's loss undoes it.

    The table goes with dropped(), drop_written() or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(_delete_all)
    _TABLES[path] = spark, threading.get_ident()
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that goes as a written table does."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_delete_all)
    _TABLES[path] = spark, threading.get_ident()
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for table in tables:
        _delete(table._larkspur_path)


def tables_written() -> set[str]:
    """The written tables of this thread that are still there."""
    return {p for p, (_, thread) in list(_TABLES.items()) if thread == threading.get_ident()}


def drop_written(since: set[str] = frozenset(), keep: Sequence[DataFrame] = ()) -> None:
    """Deletes the tables that this thread has written since tables_written() gave `since`, but for keep: all that read them must be stored by then.

    What shuffles have left on executors' disks goes when the driver's JVM collects its garbage, which it is asked to do.
    """
    gone = tables_written() - set(since) - {t._larkspur_path for t in keep}
    spark = next((_TABLES[p][0] for p in gone), None)
    for path in gone:
        _delete(path)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended
            spark._jvm.System.gc()


def _delete_all() -> None:
    for path in list(_TABLES):
        _delete(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(path: str) -> None:
    spark, _ = _TABLES.pop(path, (None, 0))
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended; a table that stays is no wrong result
            at, fs = _path(spark, path)
            fs.delete(at, True)


#: Bytes of a written table's files that may be broadcast; in memory it takes some three times that.
BROADCAST_BYTES = 2 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a written table's files have BROADCAST_BYTES at most."""
    at, fs = _path(table.sparkSession, table._larkspur_path)
    return fs.getContentSummary(at).getLength() <= BROADCAST_BYTES


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table, with a hint to broadcast it if it is small; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if is_small(table) else table
