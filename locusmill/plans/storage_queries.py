"""Queries over stored tables: an index that follows its documents, and batches that are published all or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.operators.key_index import KeyIndex
from locusmill.plans.registry import query, table
from locusmill.plans.text_queries import _PROSE
from locusmill.sources.published import Published
from locusmill.sources.tables import fresh_path
from locusmill.streaming.snapshots import feed


@query(rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text || ' one more word' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 8
  UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 100 = 9),
p AS (SELECT doc_id, string_split({_PROSE}, ' ') AS w FROM d)
SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS BIGINT) AS n_keys FROM p
""")
def followed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each document in an index that was built, then brought to a version in which one document in a hundred changed, went or came."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.col("doc_id") % 100
    new = docs.where(number != 8).withColumn("text", F.when(number == 7, F.concat("text", F.lit(" one more word"))).otherwise(F.col("text")))
    new = new.unionByName(docs.where(number == 9).withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    normal = lambda df: df.select("doc_id", T.normal_prose("text", composed=True).alias("text"))
    index = KeyIndex(spark, buckets=64)
    index.build(normal(docs))
    index.update(normal(new))
    return index.read().groupBy("doc_id").agg(F.count("key").alias("n_keys"))


_BATCHES = 3


@query(f"""
SELECT user_id, count(*) AS entries, count(*) FILTER (event_type <> 'error') AS records, count(*) FILTER (event_type = 'error') AS waiting FROM events GROUP BY user_id
""")
def published_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of annotations: each batch is published with its outbox, first tried with a part that fails, then run, then run again."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    source = feed(spark, [events.where(F.col("event_id") % _BATCHES == i) for i in range(_BATCHES)])
    schema = spark.read.parquet(source).schema
    shown = Published(spark, fresh_path(spark, "published"), {"records": schema, "outbox": schema})

    def publish(batch: DataFrame, number: int) -> None:
        # Errors go to the outbox, everything else is a record; both of a batch or neither.
        failed = batch.where("event_type = 'error'")
        broken = failed.withColumn("event_id", F.raise_error(F.lit("the second part fails")).cast("bigint"))
        try:
            shown.publish(number, {"records": batch.where("event_type <> 'error'"), "outbox": broken})
        except Exception:  # the write of a part failed, as it was made to
            if str(number) in shown.batches():
                raise
        for _ in range(2):
            shown.publish(number, {"records": batch.where("event_type <> 'error'"), "outbox": failed})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.option("checkpointLocation", fresh_path(spark, "published-state")).trigger(availableNow=True).foreachBatch(publish).start().awaitTermination()
    shown.swept()
    records, outbox = (shown.read(p).groupBy("user_id").agg(F.count(F.lit(1)).alias(n)) for p, n in (("records", "records"), ("outbox", "waiting")))
    both = records.join(outbox, "user_id", "full").select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "waiting")))
    return both.withColumn("entries", F.col("records") + F.col("waiting"))
