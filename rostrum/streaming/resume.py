"""Resumable processing.

A hand-kept offset becomes a checkpoint: a file stream reads what is new, runs the same
stateless operators as the batch, and stops. There is no state and no watermark.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def unprocessed(df: DataFrame, done: DataFrame, key="id") -> DataFrame:
    """Rows whose id was not processed yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def process_new(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    fmt: str = "json",
    files_per_trigger: int = 1000,
) -> None:
    """Run ``transform`` on the files that arrived since the last run.

    Each batch is written to its own folder ``batch=<n>`` in overwrite mode, so a batch
    that is repeated after a failure replaces its own rows and adds none.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt).load(source)
    )
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a new temporary folder, and a cluster one
    in the warehouse, which its executors share too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="rostrum-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for several later steps to read.

    A lost executor costs them nothing but reading it again.
    """
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
