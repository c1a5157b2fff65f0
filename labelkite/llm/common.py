"""What the corpus operators share: the shared folder, written intermediate tables and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


#: Of local sessions without a shared folder, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the session names none, a local session (tests, a laptop) gets one on this machine; any other is an error, since
    executors elsewhere wouldn't see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='labelkite-')}"
        found = _local[app]
    return found.rstrip("/")


class _Scratch(threading.local):
    """Tables written within ``scratch``, by its name, and the names that are open; each thread has its own."""

    def __init__(self):
        self.made: dict[str, list[str]] = {}
        self.scope: list[str] = []


_scratch = _Scratch()


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables written within belong to ``name``; those of an earlier use of it are removed on entering.

    For work whose results have been written elsewhere by the time that the name is used again.
    """
    remove(spark, _scratch.made.pop(name, []))
    _scratch.scope.append(name)
    try:
        yield
    finally:
        _scratch.scope.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/labelkite-{name}-{uuid.uuid4().hex}"
    if _scratch.scope:
        _scratch.made.setdefault(_scratch.scope[-1], []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, and Python work above it isn't run twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables from ``written``, or selected from one, that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, list({unquote(f).rpartition("/")[0] for f in t.inputFiles()}))  # files are given as URIs


#: Bytes of a batch that a Python worker gets at once, instead of Spark's 64 MB: a batch is held several times over.
BATCH_BYTES = "8m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be read by Python in batches of bounded size. A session that has set the size itself keeps it."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == "67108864b":
        conf.set(name, BATCH_BYTES)
    return df


#: What clears the caches of this worker process, by the name of the operator that has them.
_caches: dict[str, object] = {}


def only(name: str, clear=None) -> None:
    """Caches of one operator at a time: a worker process outlives its task, and clears here what other operators left in it.

    ``clear``: empties the caches that ``name`` is about to fill.
    """
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    if others:
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # where the C library has it, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
    if clear:
        _caches[name] = clear


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as none of ``columns`` has (letters' case doesn't tell names apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever number of times ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once for each row, also where a filter on it or several columns follow.

    A filter on a projected column is pushed below the projection and works it out once more; it isn't pushed below this.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
