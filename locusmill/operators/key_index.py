"""A stored index of location keys that follows its documents by what changed (STR-04).

The index is a table of doc_id, digest (of the content) and its keys, in buckets of doc_id; it is read as one row for
each key. An update compares digests: only documents whose content is new are keyed, those that are gone are left out, and only
buckets with such a document are written again, each replaced as a partition once all are read; rows of the others in them
are copied, not made anew. A bucket that fails is written again from its documents, since digests of what it holds don't agree.
Texts are shuffled once, by bucket, and keyed where they are.

Defined cases: a null text counts as empty and has no keys; a document without keys has one row with a null
key, so that its digest is known; rows that repeat a doc_id must agree in content, and count once; a null doc_id is
left out; an empty table gives an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions.text import text_of
from locusmill.sources.tables import Scratch, discard, fresh_path

BUCKETS = 256


def location_keys(text: Column, words: int = 3) -> Column:
    """Hashes of all runs of ``words`` words, each once: what a quote of more words shares with every text that holds it."""
    cut = lambda ws: F.when(F.size(ws) >= words, F.transform(F.sequence(F.lit(1), F.size(ws) - words + 1), lambda i: F.xxhash64(F.slice(ws, i, words))))
    found = F.get(F.transform(F.array(F.split(text, " ", -1)), cut), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.expr("cast(array() as array<bigint>)")))


class KeyIndex:
    """The index below a path."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, words: int = 3) -> None:
        self._spark, self._words, self._buckets = spark, words, buckets
        self.path = (path or fresh_path(spark, "key-index")).rstrip("/")

    def _stored(self) -> DataFrame:
        return self._spark.read.schema("doc_id bigint, digest bigint, n_keys int, keys array<bigint>, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        """doc_id, digest, key and bucket of every key; a document without keys has a null one."""
        return self._stored().select("doc_id", "digest", F.explode_outer("keys").alias("key"), "bucket")

    def _known(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, text and bucket of each document, dealt by bucket; who wants no text moves none."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self._buckets)).cast("int")
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
        return rows.select("doc_id", F.xxhash64("text").alias("digest"), "text", bucket.alias("bucket")).repartition("bucket").dropDuplicates(["bucket", "doc_id"])

    def _keyed(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "digest", location_keys(F.col("text"), self._words).alias("keys"), "bucket").select("doc_id", "digest", F.size("keys").alias("n_keys"), "keys", "bucket")

    def _write(self, rows: DataFrame) -> None:
        # Rows are dealt by bucket: one task for each bucket that is written, and files of one bucket in each.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def build(self, docs: DataFrame) -> None:
        """The index of ``docs`` (doc_id, text) in place of any other."""
        discard(self._spark, self.path)
        self._write(self._keyed(self._known(docs)))

    def update(self, docs: DataFrame) -> dict[str, int]:
        """Brings the index to ``docs``; how many documents were keyed and left out, and buckets and rows written."""
        with Scratch(self._spark) as scratch:
            now = self._known(docs).select("doc_id", "digest", "bucket")
            held = self._stored().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("bucket").alias("_bucket"))
            differs = now.join(held, F.col("doc_id") == F.col("_id"), "full").where("_digest is null or digest is null or digest <> _digest")
            differs = scratch.saved(differs.select(F.coalesce("doc_id", "_id").alias("doc_id"), F.col("digest").isNotNull().alias("stays"), F.coalesce("bucket", "_bucket").alias("bucket")), "index-changes")
            facts = differs.agg(F.count_if("stays").alias("keyed"), F.count_if(~F.col("stays")).alias("left_out"), F.count_distinct("bucket").alias("buckets")).first()
            touched = differs.select("bucket").distinct()
            empty = touched.join(self._known(docs).select("bucket").distinct(), "bucket", "left_anti").collect()  # at most the number of buckets
            kept = self._stored().join(touched, "bucket", "left_semi").join(differs.select("doc_id"), "doc_id", "left_anti")
            # Only texts that are new are normalised again.
            made = self._keyed(self._known(docs.join(differs.where("stays").select("doc_id"), "doc_id", "left_semi")))
            self._write(kept.select(made.columns).unionByName(made).repartition("bucket"))
            for (bucket,) in empty:
                discard(self._spark, f"{self.path}/bucket={bucket}")
            written = self._stored().join(touched, "bucket", "left_semi").agg(F.sum(F.greatest("n_keys", F.lit(1)))).first()[0]
        return {"keyed": facts.keyed, "left_out": facts.left_out, "buckets": facts.buckets, "rows": written or 0}
