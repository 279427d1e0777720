"""Queries of the keyed record operators, over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.operators import locate, records
from locusmill.plans.locate_queries import _FOUND, _sides
from locusmill.plans.registry import query, table
from locusmill.streaming.snapshots import run_to_end


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("hour", F.expr("date_format(ts, 'yyyy-MM-dd HH')"))


@query("""
SELECT sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d %H'))) AS fingerprint, count(*) AS occurrences,
  min(ts) AS first_seen, max(ts) AS last_seen, arg_min(props, (ts, event_id)) AS first_evidence, arg_max(props, (ts, event_id)) AS latest_evidence
FROM events GROUP BY user_id, event_type, strftime(ts, '%Y-%m-%d %H')
""")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type", "hour"]
    rolled = records.rolled_up(_events(spark, sf_dir), keys, ["ts", "event_id"], "props")
    return rolled.select(
        F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), 256).alias("fingerprint"), "occurrences", F.col("first.ts").alias("first_seen"),
        F.col("last.ts").alias("last_seen"), F.col("first.evidence").alias("first_evidence"), F.col("last.evidence").alias("latest_evidence"),
    )


@query("""
SELECT event_id, ts, event_type FROM events WHERE contains(lower(event_type || ' ' || props), 'ck') ORDER BY ts DESC, event_id
""")
def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.contains(F.lower(F.concat("event_type", F.lit(" "), "props")), F.lit("ck"))
    return table(spark, sf_dir, "events").where(found).select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id")


@query("""
SELECT e.event_id, e.user_id FROM events e WHERE event_type = 'error'
  AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'view' AND o.user_id = e.user_id AND strftime(o.ts, '%Y-%m-%d %H') = strftime(e.ts, '%Y-%m-%d %H'))
""")
def import_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return records.without(events.where("event_type = 'error'"), events.where("event_type = 'view'"), ["user_id", "hour"]).select("event_id", "user_id")


@query("""
SELECT v.event_id, v.user_id FROM events v LEFT JOIN (SELECT user_id, max(ts) AS gone FROM events WHERE event_type = 'error' GROUP BY ALL) d USING (user_id)
WHERE v.event_type = 'view' AND (gone IS NULL OR v.ts > gone)
""")
def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return records.not_deleted_since(events.where("event_type = 'view'"), events.where("event_type = 'error'"), "user_id", "ts").select("event_id", "user_id")


@query("""
SELECT event_id, s AS http_status, CASE WHEN s = 200 THEN 'done' WHEN s = 429 OR s >= 500 THEN 'retry' ELSE 'error' END AS action
FROM (SELECT event_id, CASE WHEN value < 5 THEN 200 WHEN value < 10 THEN 429 WHEN value < 15 THEN 404 ELSE 503 END AS s FROM events)
""")
def outbox_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 5, 200).when(F.col("value") < 10, 429).when(F.col("value") < 15, 404).otherwise(503)
    return table(spark, sf_dir, "events").select("event_id", status.alias("http_status")).withColumn("action", records.retry_action(F.col("http_status")))


@query("SELECT event_id, ts, props FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def archive_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "props").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("""
SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE ORDER BY ts DESC, event_id DESC LIMIT 50
""")
def ticket_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    live = events.join(F.broadcast(now), F.expr("ts > now - INTERVAL 10 MINUTE"))
    return live.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE NOT coalesce(kind <> event_type AND epoch_us(ts) - epoch_us(before) <= 3600000000, false)
""")
def activation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records.paired_dropped(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 3600)
    return kept.select("event_id", "user_id", "event_type")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(md5(text), turn) AS text_md5 FROM conversations GROUP BY conv_id, role")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.latest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn", "text"])
    return rows.select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


@query("""
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run
""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
WITH r AS (SELECT event_id * 2 AS o_orderkey, event_id, CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'F' ELSE 'P' END AS expected FROM events)
SELECT event_id, r.o_orderkey, expected, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN o_orderstatus = expected THEN 'ok' ELSE 'conflict' END AS status
FROM r LEFT JOIN orders o ON o.o_orderkey = r.o_orderkey
""")
def cas_update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("event_type") == "view", "O").when(F.col("event_type") == "click", "F").otherwise("P")
    requests = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("o_orderkey"), expected.alias("expected"))
    return records.compare_and_set(requests, table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("event_id", "o_orderkey", "expected", "status")


@query("""
WITH c AS (SELECT user_id * 100 AS o_orderkey, arg_max(CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'F' ELSE 'P' END, (ts, event_id)) AS o_orderstatus FROM events GROUP BY user_id)
SELECT c.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN o.o_orderstatus = c.o_orderstatus THEN 'noop' ELSE 'update' END AS action, c.o_orderstatus
FROM c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey
""")
def annotation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "O").when(F.col("event_type") == "click", "F").otherwise("P")
    changes = records.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select((F.col("user_id") * 100).alias("o_orderkey"), status.alias("o_orderstatus"))
    return records.upsert_plan(table(spark, sf_dir, "orders"), changes, "o_orderkey", "o_orderstatus")


@query("""
SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS item, count(*) AS candidates, count_if(o_orderstatus = 'O') AS exact
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def item_resolution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    newest = F.max(F.struct("o_orderdate", -F.col("o_orderkey")))["col2"]
    by_customer = orders.groupBy("c_custkey").agg((-newest).alias("item"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("o_orderstatus") == "O").alias("exact"))
    return by_customer.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("""
SELECT o_orderkey, c_name, count(*) AS n_lines, min(l_linenumber) AS first_line FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R' GROUP BY ALL
""")
def annotation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_linenumber").alias("first_line"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    named = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return named.join(lines, "o_orderkey").select("o_orderkey", "c_name", "n_lines", "first_line")


@query("""
SELECT l_orderkey, l_linenumber, concat_ws('|', lpad(left(CAST(l_linenumber AS VARCHAR), 5), 5, '0'), lpad(left(CAST(l_orderkey AS VARCHAR), 6), 6, '0'),
  lpad(left(CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR), 5), 5, '0')) AS place FROM lineitem
""")
def sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = T.place_key(F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


@query("""
WITH w AS (SELECT conv_id, role, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS weight FROM conversations GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, role) AS k, coalesce(lead(weight) OVER (PARTITION BY conv_id ORDER BY weight DESC, role), 0) AS second,
  sum(weight) OVER (PARTITION BY conv_id) AS total FROM w)
SELECT conv_id, role, weight, second, weight >= 0.7 * total AND weight - second >= 8 AS accepted FROM r WHERE k = 1
""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.vote(table(spark, sf_dir, "conversations"), "conv_id", "role", F.length(T.text_of("text")))


@query("SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id HAVING count(DISTINCT role) = 3")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.covers_all(table(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"])


@query(f"""
WITH {_FOUND} SELECT lang, count(*) AS n_docs, count_if(hits > 0) AS located, count_if(hits > 1) AS several
FROM (SELECT d.doc_id, lang, count(f.doc_id) AS hits FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY ALL) GROUP BY lang
""")
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = locate.located(*_sides(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(hits, "doc_id", "left")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("hits") > 0).alias("located"), F.count_if(F.col("hits") > 1).alias("several"))


@query("SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY ALL")
def stream_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(spark, f"{sf_dir}/events*.parquet", lambda s: s.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen")))


@query("SELECT user_id, count(*) AS tries, count_if(event_type = 'error') AS failures FROM events GROUP BY ALL")
def stream_retry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lambda s: s.groupBy("user_id").agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return run_to_end(spark, f"{sf_dir}/events*.parquet", plan)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03 as state: the first row of a key passes, later ones don't; the state holds keys alone."""
    first = lambda s: s.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")
    return run_to_end(spark, f"{sf_dir}/events*.parquet", first, mode="append")


@query("""
WITH m AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, contains(event_type, 'rr') ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT event_id, CASE WHEN NOT contains(event_type, 'rr') THEN 'waiting' WHEN place <= 5 THEN 'archived' ELSE 'forgotten' END AS fate FROM m
""")
def outbox_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15: errors leave a user's outbox for an archive of the last five."""
    return records.archived(table(spark, sf_dir, "events"), "user_id", "event_type", "rr", ["ts", "event_id"], 5).select("event_id", "fate")
