"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark itself so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one given to setCheckpointDir. Only where both are unset and the master is local, as in tests, a temporary one."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="cellarium-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a written() table. Tables that make() wrote on its way are deleted, so nothing else may read them."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        try:
            df = make()
        finally:
            _made.reset(outer)
        return written(df, name)
    finally:
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        released(spark)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


@functools.lru_cache(1)
def held(make: Callable, *args):
    """make(*args), which a Python worker keeps for its next tasks of the same kind, until begun()."""
    return make(*args)


def begun() -> None:
    """To be called first by tasks that need nothing held(): a worker goes from stage to stage, with all that earlier tasks held and freed, until this gives it back."""
    held.cache_clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that df has as columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def hex64(col):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
