"""Streams with state over files out of order: tickets, import jobs, tombstones, and answers that may be stale."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.plans.registry import query, table
from locusmill.sources.tables import Scratch, saved
from locusmill.streaming import answers, jobs, tickets
from locusmill.streaming.in_order import closing, rocks_state
from locusmill.streaming.snapshots import copied, feed, run_to_end

#: Parts that the events come in, a sixth of the time each; one event in seven comes a part late. A part is a micro-batch, in files of some so many rows.
FILES = 6
FILE_ROWS = 250_000
DAYS = 30 / FILES
DELAY = f"{2 * int(DAYS) + 1} days"


def _fed(spark: SparkSession, sf_dir: str, kinds: dict[str, str], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The output of a stream over events whose types are named anew, part by part, out of order."""
    name = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.element_at(name, F.col("event_type")).alias("kind")).where("kind is not null")
    late = F.when(F.col("event_id") % 7 == 3, 1).otherwise(0)
    number = F.least(F.floor((F.dayofmonth("ts") - 1) / DAYS) + late, F.lit(FILES - 1))
    with Scratch(spark) as scratch:
        # Parts are told apart once, and no file is the work of one task alone.
        rows = scratch.saved(events.withColumn("part", number), "stream-rows", by="part")
        files = _files(rows.count())
        parts = [rows.where(F.col("part") == i).drop("part").repartition(files).sortWithinPartitions(F.desc("event_id")) for i in range(FILES)]
        # Closing rows, later and later, let all that waits pass; as many files of them as of a part, so that they don't share a micro-batch.
        parts += [copied(closing(rows.drop("part"), "user_id", days), files) for days in (400, 800)]
        source = feed(spark, parts, dealt=True)
    with rocks_state(spark):
        return run_to_end(spark, source, plan, mode="append", files=files)


def _files(rows: int) -> int:
    """Files of each part of a feed of so many rows. A part of few rows may have fewer, and the next one's then join its micro-batch, which only holds the watermark back."""
    return max(1, math.ceil(rows / (FILES * FILE_ROWS)))


@query("""
SELECT p.event_id, p.user_id, arg_max(s.event_id, (s.ts, s.event_id)) AS ticket FROM events p
LEFT JOIN events s ON s.event_type = 'signup' AND s.user_id = p.user_id AND (s.ts, s.event_id) < (p.ts, p.event_id) AND s.ts > p.ts - INTERVAL 1 DAY
WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id
""")
def stream_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, JN-29: purchases redeem the newest signup of their user that is less than a day old, whatever the order of the files."""
    return _fed(spark, sf_dir, {"signup": "signup", "purchase": "purchase"}, lambda s: tickets.redeemed(s, "user_id", "signup", "purchase", 86_400, 50, DELAY))


_LIMIT, _BACK_OFF, _KEEP = 6 * 3600, 12 * 3600, 3 * 86_400
_DUE = f"since + 1000000::BIGINT * CASE status WHEN 'fetching' THEN {_LIMIT} WHEN 'failed' THEN {_BACK_OFF} ELSE {_KEEP} END"


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS moment, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'missing' ELSE 'poll' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'purchase', 'error', 'view')
  UNION ALL SELECT user_id, NULL, epoch_us(max(ts)) + 400 * 86400000000, 'end', count(*) FILTER (event_type IN ('click', 'purchase', 'error', 'view')) + 1 FROM events GROUP BY user_id),
-- The state before event n once what fell due by then is settled: a fetch that timed out has failed, and may be over as well.
m(user_id, n, event_id, moment, kind, status, since, lapse, lapse_at, answer) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'idle'::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, moment, kind,
    CASE WHEN kind = 'start' AND now = 'idle' THEN 'fetching' WHEN kind = 'saved' AND now = 'fetching' THEN 'saved' WHEN kind = 'missing' AND now = 'fetching' THEN 'failed' ELSE now END,
    CASE WHEN (kind = 'start' AND now = 'idle') OR (kind IN ('saved', 'missing') AND now = 'fetching') THEN moment ELSE now_since END, lapse, lapse_at,
    CASE kind WHEN 'poll' THEN now WHEN 'start' THEN CASE now WHEN 'idle' THEN 'started' WHEN 'fetching' THEN 'joined' WHEN 'saved' THEN 'done' ELSE 'refused' END
      WHEN 'saved' THEN CASE now WHEN 'fetching' THEN 'saved' ELSE 'ignored' END WHEN 'missing' THEN CASE now WHEN 'fetching' THEN 'no-pdf' ELSE 'ignored' END END
  FROM (
    SELECT e.user_id, e.n, e.event_id, e.moment, e.kind,
      CASE WHEN status = 'idle' OR due > e.moment THEN status WHEN status = 'fetching' AND due + 1000000::BIGINT * {_BACK_OFF} > e.moment THEN 'failed' ELSE 'idle' END AS now,
      CASE WHEN due > e.moment THEN since WHEN status = 'fetching' THEN due END AS now_since,
      CASE WHEN due <= e.moment AND status = 'fetching' THEN 'timed-out' WHEN due <= e.moment AND status = 'saved' THEN 'forgotten' END AS lapse, CASE WHEN due <= e.moment THEN due END AS lapse_at
    FROM (SELECT *, {_DUE} AS due FROM m) m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1) x)
SELECT user_id, event_id, moment AS "at", answer FROM m WHERE answer IS NOT NULL UNION ALL SELECT user_id, NULL, lapse_at, lapse FROM m WHERE lapse IS NOT NULL
""")
def stream_import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, STR-16: clicks start a user's job, purchases and errors end it, views poll it."""
    kinds = {"click": "start", "purchase": "saved", "error": "missing", "view": "poll"}
    return _fed(spark, sf_dir, kinds, lambda s: jobs.import_jobs(s, "user_id", _LIMIT, _BACK_OFF, _KEEP, DELAY))


@query("""
WITH x AS (SELECT *, max(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER w AS deleted, max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER w AS gone
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, epoch_us(ts) AS "at", CASE WHEN deleted IS NOT NULL AND (gone IS NULL OR deleted > gone) THEN 'hidden' ELSE 'shown' END AS answer FROM x WHERE event_type = 'view'
""")
def stream_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: views list a user's record, errors delete it here, purchases confirm that."""
    return _fed(spark, sf_dir, {"view": "listed", "error": "deleted", "purchase": "gone"}, lambda s: jobs.shown(s, "user_id", DELAY))


_REQUESTS = "r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type IN ('view', 'click'))"


@query(f"""
WITH {_REQUESTS}, a AS (SELECT *, ts + to_hours(CAST(event_id % 5 * 4 AS INTEGER)) AS answered_at FROM r)
SELECT a.user_id AS address, a.number, a.event_id AS payload, epoch_us(a.answered_at) AS answered_at FROM a LEFT JOIN r n ON n.user_id = a.user_id AND n.number = a.number + 1
WHERE a.event_id % 5 < 4 AND (n.ts IS NULL OR n.ts > a.answered_at)
""")
def stream_current_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05, STR-06: views and clicks ask for a user's records; answers take 0 to 16 hours, of which 12 are allowed, and one in three comes twice."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    asked = events.select(F.col("user_id").alias("address"), number.cast("bigint").alias("number"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("payload"), F.lit(False).alias("answer"))
    delay = F.make_interval(hours=(F.col("payload") % 5 * 4).cast("int"))
    came = asked.select("address", "number", (F.col("at") + delay).alias("at"), "payload", F.lit(True).alias("answer"))
    came = came.unionByName(came.where("payload % 3 = 0"))
    rows = asked.unionByName(came)
    late = F.when(F.col("payload") % 7 == 3, 1).otherwise(0)
    part = F.least(F.floor((F.dayofyear("at") - 1) / DAYS) + late, F.lit(FILES - 1))
    # Numbered once, not once for every file.
    rows = saved(rows.withColumn("part", part), "stream-rows")
    parts = [rows.where(F.col("part") == i).drop("part").orderBy(F.desc("payload")) for i in range(FILES)]
    last = rows.agg(F.max("at").alias("at"))
    for days in (400, 800):
        for kind in (False, True):
            parts.append(last.select(F.lit(-1).cast("bigint").alias("address"), F.lit(days).cast("bigint").alias("number"), (F.col("at") + F.expr(f"interval {days} days")).alias("at"), F.lit(None).cast("bigint").alias("payload"), F.lit(kind).alias("answer")).select(*parts[0].columns))

    def plan(stream: DataFrame) -> DataFrame:
        requests = stream.where("not answer").select("address", "number", F.col("at").alias("asked_at"))
        found = answers.current_answers(requests, stream.where("answer").select("address", "number", F.col("at").alias("answered_at"), "payload"), "12 hours", DELAY)
        return found.select("address", "number", "payload", F.unix_micros("answered_at").alias("answered_at"))

    with rocks_state(spark):
        found = run_to_end(spark, feed(spark, parts), plan, mode="append", files=1)
    # Closing rows are left out at the end only: a filter inside the stream would keep them from the watermarks.
    return found.where("address >= 0")
