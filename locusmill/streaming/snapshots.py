"""Streams over files, run until nothing new is left (STR-03, STR-20)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.sources.tables import fresh_path

PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of a whole feed for each state partition: as many as pay for a task, and as many as one may hold.
LEAST_ROWS, MOST_ROWS = 20_000, 500_000


def state_partitions(rows: int, cores: int) -> int:
    """Every micro-batch commits every store of every partition, so a stream has as many as its rows and the cores ask for."""
    return max(1, min(cores, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / MOST_ROWS))


@contextmanager
def _partitioned(spark: SparkSession, n: int) -> Iterator[None]:
    """Streams that start within deal their state over ``n`` partitions."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(n))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def run_to_end(spark: SparkSession, source: str, plan: Callable[[DataFrame], DataFrame], mode: str = "complete", files: int | None = None) -> DataFrame:
    """The output of a stream over the Parquet files of ``source``, at most ``files`` of them in a micro-batch.

    State and output live in the folder that the cluster shares. In ``complete`` mode each batch
    replaces the table; in ``append`` and ``update`` mode each batch has a folder of its own, so a
    batch that is run again after a loss replaces its own rows alone.
    """
    base = fresh_path(spark, "stream")
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    stream = plan((reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source))

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{base}/table" if mode == "complete" else f"{base}/table/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    n = state_partitions(spark.read.parquet(source).count(), spark.sparkContext.defaultParallelism)
    with _partitioned(spark, n):
        started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{base}/table")
    return found.select(*stream.columns)


def feed(spark: SparkSession, parts: list[DataFrame], dealt: bool = False) -> str:
    """A folder with one Parquet file for each part, or for each partition of it where parts are ``dealt``, in the order in which a stream over it takes them."""
    path = fresh_path(spark, "feed")
    for part in parts:
        (part if dealt else part.coalesce(1)).write.mode("append").parquet(path)
    return path


def copied(rows: DataFrame, files: int) -> DataFrame:
    """A few rows, once in each of so many partitions."""
    return rows.sparkSession.range(0, files, 1, files).crossJoin(F.broadcast(rows)).drop("id")
