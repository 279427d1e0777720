"""Answers that may be stale: stream-stream joins of requests and answers (STR-05, STR-06).

Defined cases: an answer without its request, one that comes after the time allowed, one that was asked for again
before it came, and repeats of one are dropped; answers without address or number are dropped; rows
later than a watermark's delay are dropped by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_answers(requests: DataFrame, answers: DataFrame, allowed: str, delay: str) -> DataFrame:
    """address, number, asked_at, answered_at and payload of each answer that is still wanted when it comes.

    ``requests`` is a stream of address, number and asked_at, numbered from 1 without gaps for each
    address; ``answers`` one of address, number, answered_at and payload. An answer is wanted if it comes within
    ``allowed`` of its request and no later request for its address was made by then. State on every
    side is dropped once the watermarks have passed the time allowed.
    """
    span = F.expr(f"interval {allowed}")
    asked = requests.select("address", "number", F.col("asked_at").cast("timestamp").alias("asked_at")).withWatermark("asked_at", delay)
    came = answers.select(
        F.col("address").alias("_address"), F.col("number").alias("_number"), F.col("answered_at").cast("timestamp").alias("answered_at"), "payload"
    ).withWatermark("answered_at", delay)
    # A repeat is the same answer at the same time; the time in the key lets its state go with the watermark.
    came = came.dropDuplicates(["_address", "_number", "answered_at"])
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + span)
    paired = came.join(asked, (F.col("address") == F.col("_address")) & (F.col("number") == F.col("_number")) & in_time)
    # A stream has one column of event time: what the answers bring; the request's goes on as a number.
    paired = paired.select("address", "number", F.unix_micros("asked_at").alias("_asked"), "answered_at", "payload")
    again = requests.select(F.col("address").alias("_again"), (F.col("number") - 1).alias("_before"), F.col("asked_at").cast("timestamp").alias("again_at")).withWatermark("again_at", delay)
    overtaken = (F.col("address") == F.col("_again")) & (F.col("number") == F.col("_before")) & (F.unix_micros("again_at") >= F.col("_asked"))
    while_waiting = (F.col("again_at") >= F.col("answered_at") - span) & (F.col("again_at") <= F.col("answered_at"))
    left = paired.join(again, overtaken & while_waiting, "left_outer")
    return left.where("_again is null").select("address", "number", F.timestamp_micros("_asked").alias("asked_at"), "answered_at", "payload")
