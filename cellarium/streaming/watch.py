"""Inference over files as they arrive."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cellarium.operators.cells import cells
from cellarium.operators.infer import infer


def watch(spark: SparkSession, path: str, schema, sheet: str, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Infers column types of each batch of new files and hands them to sink(df, batch). once: what is there now, then end."""
    stream = spark.readStream.schema(schema).format(fmt).load(path)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(infer(cells(df, sheet, key)), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def inferred_files(spark: SparkSession, path: str, sheet: str, key: str) -> DataFrame:
    """The column types of the Parquet files that are at path now, through a stream that ends when it has seen them. Its batch and progress lie in the shared folder of the session."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name single files, a plain path only folders
    query = watch(spark, pattern, schema, sheet, key, lambda df, n: df.write.mode("append").parquet(f"{base}/types"), f"{base}/progress")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/types")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one where none is set and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='cellarium-')}"
