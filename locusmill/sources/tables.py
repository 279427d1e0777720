"""Tables in and out: the named tables of a folder, and intermediate ones that outlive a lost executor.

Every cut of a lineage is a Parquet table below ``spark.checkpoint.dir``, the folder that all
executors of a cluster share. Only a local session may leave that setting out; it takes a folder
of its one machine. On a cluster a missing setting is an error, as each machine would write and
read a folder of its own.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
LOCAL_DIR = "file:///tmp/checkpoints/locusmill"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some ``BATCH_BYTES``, unless the session has a size of its own.

    A batch of texts is held several times over, by the JVM, as Arrow and as Python strings. Spark
    has the size as a setting of the session alone; one that is set already is left alone.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def dealt(rows: DataFrame, key: str, n_rows: int, each: int) -> DataFrame:
    """``rows`` by ``key``, in parts that hold some ``each`` of the ``n_rows`` however many there are.

    No fewer parts than a shuffle has; their number is set, so none are put together again. What is
    made of a row stays in its part: groups and windows over ``key`` and more move nothing.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, math.ceil(n_rows / each)), key)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate files, without a slash at its end."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (set_dir or LOCAL_DIR).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, codec: str = "zstd", path: str | None = None, by: str | None = None) -> DataFrame:
    """Writes ``df`` once, in folders by a column if one is named, and returns the table read back; later plans start from its files."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``fresh_path`` that no result reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one job, deleted together at its end. What the job returns must not read them."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._paths: list[str] = []

    def saved(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        self._paths.append(path := fresh_path(self._spark, label))
        return saved(df, label, path=path, by=by)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        for path in self._paths:
            discard(self._spark, path)
