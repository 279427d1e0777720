"""Batches that are published all or not at all, the index that follows its documents, and events in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from locusmill.operators.key_index import KeyIndex
from locusmill.sources.published import Published
from locusmill.sources.tables import fresh_path
from locusmill.streaming import jobs
from locusmill.streaming.in_order import closing, rocks_state
from locusmill.streaming.snapshots import feed, run_to_end


def test_a_batch_is_published_whole_or_not_at_all(spark):
    rows = spark.range(10).withColumn("page", F.col("id") % 3)
    shown = Published(spark, fresh_path(spark, "published-test"), {"pages": rows.schema, "outbox": rows.schema})
    assert shown.read("pages").count() == 0 and shown.batches() == []
    broken = rows.withColumn("page", F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("page")))
    with pytest.raises(Exception, match="no"):
        shown.publish(0, {"pages": rows, "outbox": broken})
    assert shown.read("pages").count() == shown.read("outbox").count() == 0
    assert shown.publish(0, {"pages": rows, "outbox": rows.limit(0)}) and not shown.publish(0, {"pages": rows, "outbox": rows})
    assert shown.read("pages").count() == 10 and shown.read("outbox").count() == 0
    # A run that lost the race finds the manifest in its place.
    assert not shown._put_manifest("0", {"folder": f"{shown._path}/data/other", "replaces": []})
    assert shown.publish("late", {"pages": rows.where("id < 2"), "outbox": rows.where("id < 1")})
    assert shown.swept() == 1 and shown.read("pages").count() == 12
    assert shown.compacted("all") and not shown.publish(0, {"pages": rows, "outbox": rows})
    assert shown.read("pages").count() == 12 and shown.read("outbox").count() == 1
    assert shown.swept() == 2 and sorted(r.id for r in shown.read("pages").collect()) == sorted([*range(10), 0, 1])
    with pytest.raises(ValueError, match="parts"):
        shown.publish(1, {"pages": rows})


def as_set(index):
    return {(r.doc_id, r.digest, r.key, r.bucket) for r in index.read().collect()}


def test_an_index_after_a_change_is_that_of_a_full_build(spark):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(40)))
    old = {i: say() for i in range(1000)}
    new = {**{i: t for i, t in old.items() if i % 100 != 1}, **{i: say() + " new" for i in range(5, 1000, 200)}, 2001: say(), 2002: None}
    frame = lambda d: spark.createDataFrame([*d.items(), (None, "x")], "doc_id bigint, text string").repartition(4)
    index, full = KeyIndex(spark, buckets=64), KeyIndex(spark, buckets=64)
    index.build(frame(old))
    before = len(as_set(index))
    assert index.update(frame(old)) == {"keyed": 0, "left_out": 0, "buckets": 0, "rows": 0}
    facts = index.update(frame(new))
    full.build(frame(new))
    assert as_set(index) == as_set(full)
    assert (facts["keyed"], facts["left_out"]) == (7, 10) and facts["buckets"] <= 17 and facts["rows"] < before / 2
    assert index.update(frame({}))["left_out"] == 992 and as_set(index) == set()


EVENTS = "event_id bigint, user_id bigint, ts timestamp, kind string"


def test_late_events_take_their_place_and_later_ones_are_dropped(spark):
    start = datetime(2024, 1, 1)
    at = lambda i, user, hours, kind: (i, user, start + timedelta(hours=hours), kind)
    files = [
        [at(1, 7, 0, "listed"), at(2, 7, 10, "listed"), at(3, None, 1, "deleted")],
        [at(4, 7, 5, "deleted"), at(5, 7, 20, "listed"), at(6, None, 2, "listed")],  # 4 and 6 are late, within the delay
        [at(7, 7, 60, "listed"), at(8, 7, 60, "gone")],
        [at(9, 7, 61, "listed")],
        [at(10, 7, 3, "gone"), at(11, 7, 62, "nothing")],  # 10 comes after the watermark has passed it
    ]
    parts = [spark.createDataFrame(f, EVENTS) for f in files]
    parts += [closing(parts[-1], "user_id", days) for days in (10, 20)]
    with rocks_state(spark):
        found = run_to_end(spark, feed(spark, parts), lambda s: jobs.shown(s, "user_id", "12 hours"), mode="append", files=1).collect()
    assert {r.event_id: r.answer for r in found} == {1: "shown", 2: "hidden", 5: "hidden", 6: "hidden", 7: "hidden", 9: "shown"}


def test_a_job_starts_once_times_out_and_is_forgotten(spark):
    job = jobs.ImportJob(limit=60, back_off=60, keep=600)
    second = jobs.SECOND
    held, log = None, []

    def at(seconds, event, kind):
        nonlocal held
        while held is not None and job.due(held) <= seconds * second:
            held, more = job.lapse(held)
            log.extend(a for *_, a in more)
        held, more = job.take(held, seconds * second, event, kind)
        log.extend(a for *_, a in more)

    for i, (s, kind) in enumerate([(0, "poll"), (1, "start"), (2, "start"), (30, "poll"), (62, "poll"), (70, "start"), (125, "start"), (130, "saved"), (131, "saved"), (140, "start"), (800, "poll")]):
        at(s, i, kind)
    assert log == ["idle", "started", "joined", "fetching", "timed-out", "failed", "refused", "started", "saved", "ignored", "done", "forgotten", "idle"]
