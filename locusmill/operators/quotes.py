"""Saved quotes found again, as they stand or as runs of whole sentences (JN-22, SET-05).

A quote is a key: letters and digits in lower case. The sentences of a document are keys, too, and
joined they are the document's. A quote stands for a run of neighbouring sentences if it is their
keys joined. Every place where a sentence begins gives an anchor, the hash of the first characters
from there on, so a run of any number of sentences has a key to join on without being spelt out; a
pair that meets is held against the text itself, and the run must end where a sentence ends.

Defined cases: quotes of fewer than ``LEAST`` characters, and null ones, are found nowhere; sentences
without a key are part of any run; a null text holds nothing; repeated quotes are found as often as
they are repeated; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.locate import places
from locusmill.operators.spans import count_up_to, once, sums_of
from locusmill.sources.tables import saved

LEAST = 12
#: Lengths of anchors: a quote joins on the longest that it fills, so that long quotes meet few places.
ANCHORS = (96, 48, 24, LEAST)


def keyed_sentences(sentences: Column) -> Column:
    """A struct of key, the keys joined, and starts, where each sentence begins in it, with the end as the last."""
    starts = lambda s: sums_of(F.transform(F.concat(s, F.array(F.lit(""))), lambda k: F.length(k).cast("bigint")))
    return once(sentences, lambda s: F.struct(F.array_join(s, "").alias("key"), starts(s).alias("starts")))


def _size(length: Column) -> Column:
    out = F.when(length >= ANCHORS[0], ANCHORS[0])
    for n in ANCHORS[1:]:
        out = out.when(length >= n, n)
    return out


def sentence_runs(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, first, last (sentences, from 0), start and stop (in the document's key) of every run that is a quote.

    ``quotes`` has quote_id and key; ``docs`` doc_id and sentences, the keys of its sentences. Of
    sentences without a key at either end of a run as few as possible belong to it.
    """
    asked = quotes.select("quote_id", F.col("key").alias("_quote"), _size(F.length("key")).alias("_size")).where("_size is not null")
    asked = asked.withColumn("_anchor", F.xxhash64(F.substring("_quote", F.lit(1), F.col("_size")), "_size"))
    held = docs.select("doc_id", keyed_sentences(F.col("sentences")).alias("_d"))
    begins = held.select("doc_id", "_d", F.explode(F.array_distinct("_d.starts")).alias("start"))
    sizes = F.explode(F.array(*map(F.lit, ANCHORS))).alias("_size")
    begins = begins.select("doc_id", "start", F.substring("_d.key", (F.col("start") + 1).cast("int"), F.lit(ANCHORS[0])).alias("_head")).select("*", sizes)
    begins = begins.where(F.length("_head") >= F.col("_size")).select("doc_id", "start", F.xxhash64(F.substring("_head", F.lit(1), F.col("_size")), "_size").alias("_anchor"))
    met = begins.join(asked, "_anchor").join(held, "doc_id")
    stop = F.col("start") + F.length("_quote")
    met = met.where(F.substring("_d.key", (F.col("start") + 1).cast("int"), F.length("_quote")) == F.col("_quote"))
    # Sentences begin at sorted places, with repeats where a key is empty.
    starts = F.col("_d.starts")
    met = met.withColumn("first", count_up_to(starts, F.col("start")) - 1).withColumn("last", count_up_to(starts, stop, strict=True))
    met = met.where(F.get(starts, F.col("last")) == stop)
    return met.select("quote_id", "doc_id", "first", (F.col("last") - 1).alias("last"), F.col("start").cast("int").alias("start"), stop.cast("int").alias("stop"))


def found_again(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, status, n_places, and doc_id, start and stop (in the document's key) where there is only one distinct place.

    Places are those where the quote stands, and the runs of sentences that it is; equal ranges count once.
    """
    keys = docs.select("doc_id", F.array_join("sentences", "").alias("text"))
    long = quotes.where(F.length("key") >= LEAST)
    stands = places(long.select(F.col("quote_id").alias("selector_id"), F.col("key").alias("text")), keys)
    stands = stands.select(F.col("selector_id").alias("quote_id"), "doc_id", F.col("at").cast("int").alias("start"), (F.col("at") + F.col("length")).cast("int").alias("stop"))
    # Runs are among what stands there, but for those that overlap a place; only documents with a quote are searched for them.
    stands = saved(stands, "quotes-standing")
    runs = sentence_runs(quotes, docs.join(stands.select("doc_id").distinct(), "doc_id", "left_semi")).select("quote_id", "doc_id", "start", "stop")
    all_ = stands.unionByName(runs).distinct().groupBy("quote_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "stop")).alias("one"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    only = [F.when(n == 1, F.col(f"one.{c}")).alias(c) for c in ("doc_id", "start", "stop")]
    status = F.when(n == 0, "not-found").when(n == 1, "unique").otherwise("ambiguous")
    return quotes.select("quote_id").join(all_, "quote_id", "left").select("quote_id", status.alias("status"), n.alias("n_places"), *only)
