"""Session helpers: the shared working folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import termloom

# Functions of this package travel to the workers with their code: executors need not have it installed. Functions that users
# hand to operators may name the package's functions and classes, not its modules.
cloudpickle.register_pickle_by_value(termloom)

#: Largest side, in estimated bytes, that an operator of this package broadcasts on its own.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a local one is made, but only for a local master (tests): on a cluster every executor would write to a
    disk of its own, so ``RuntimeError`` is raised there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _place(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.delete(p, True)


def read_small_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None where there is none."""
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and renamed, so that readers see the old or the new content."""
    fs, p = _place(spark, f"{path}.new")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, q = _place(spark, path)
    fs.delete(q, False)
    if not fs.rename(p, q):
        raise OSError(f"cannot write {path}")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session may already be gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/termloom-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`written` that nothing will read again (a round before the last)."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/termloom-" in f}:
        _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` rows of the schema of ``df`` stay below ``limit_bytes`` (64 bytes assumed for each text)."""
    width = 16 + sum(64 if f.dataType.typeName() in ("string", "binary") else 16 for f in df.schema)
    return rows * width <= limit_bytes


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are small, else unchanged for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df
