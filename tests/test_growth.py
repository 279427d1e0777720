"""Plans whose work must grow no faster than their input (round 3)."""

from __future__ import annotations

import pickle
from datetime import datetime, timedelta

import pandas as pd
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from locusmill.functions import projection as P
from locusmill.operators.key_index import KeyIndex
from locusmill.plans import ORACLES, QUERIES, stream_queries
from locusmill.streaming import in_order, jobs
from locusmill.streaming.in_order import closing
from locusmill.streaming.snapshots import feed, run_to_end


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["column_order", "recognised_words"])
def test_words_of_pages_are_dealt_once(spark, sf_dir, name):
    """texts are shuffled, not the words made of them."""
    planned = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("name", "made"), [("short_selections", "split(trim"), ("sentence_bounds", "instr(")])
def test_costly_arrays_are_made_once(spark, sf_dir, name, made):
    """neither a filter on an array's size nor a use of it makes the array again."""
    assert optimized(QUERIES[name](spark, sf_dir)).count(made) == 1


def test_british_spellings_search_a_text_once(spark):
    """F16: the text isn't made again for every spelling."""
    from locusmill.functions.text import american

    rows = spark.createDataFrame([("unnormalised and normalised, analysed; xageing ageing",), (None,)], "t string").select(american(F.upper(F.lower("t"))).alias("u"), american("t").alias("t"))
    assert [r.t for r in rows.collect()] == ["unnormalized and normalized, analyzed; xageing aging", ""]
    assert optimized(rows.select("u")).count("upper(") == 1


def test_many_ranges_are_led_back_as_each_is(spark):
    """ranges of one text are led back together, by bisection outside of lambdas."""
    rows = spark.createDataFrame([("<em>Ab</em>  cd.&nbsp; Ef   gh ",), ("plain words",), (" x",)], "t string").select(P.readable_of(P.raw("t")).alias("p"))
    at = F.sequence(F.lit(0), F.length("p.text") - 1)
    one = F.transform(at, lambda x: P.back(F.col("p.maps"), x, x + 1))
    both = rows.select(one.alias("one"), P.back_all(F.col("p.maps"), at, F.transform(at, lambda x: x + 1)).alias("all")).collect()
    assert all(r.one == r["all"] for r in both)


def test_a_quote_over_a_page_end_is_not_found_without_its_article(spark, tmp_path):
    """a quote whose first word, an article, ends a page is on no page; without the article it was found on the next."""
    quote = ["the", *(f"word{c}" for c in "abcdefghijklmn")]
    words = ["x" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(239)]
    for name, rows, schema in (("documents", [(2, " ".join(words + quote))], "doc_id long, text string"), ("benchmark", [(1, " ".join(quote))], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = QUERIES["geometry_locate"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.status for r in rows} == {"not-found"}


@pytest.mark.parametrize("name", ["alignment_groups", "alignment_reasons"])
def test_pieces_of_a_paragraph_are_brought_together_once(spark, sf_dir, name):
    """fragments, sentences and selections go to their paragraph once; beside that only keys are shuffled."""
    planned = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") <= 5


def test_an_index_moves_texts_and_not_their_keys(spark):
    """texts are shuffled once, keyed where they are, and stored as one row each."""
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(40)] + [(40, None), (None, "x")], "doc_id bigint, text string")
    index = KeyIndex(spark, buckets=4)
    index.build(docs)
    index.update(docs.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 5, "a b c").otherwise(F.col("text"))))
    assert spark.read.parquet(index.path).count() == 40
    assert index.read().count() == 38 * 5 + 1 + 1


def test_state_is_called_for_by_groups_of_keys(spark, monkeypatch):
    """keys share calls and values of state, so calls don't grow with the keys; null keys, null ids and large numbers stay as they are."""
    monkeypatch.setattr(in_order, "GROUPS", 2)
    start, big = datetime(2024, 1, 1), (1 << 60) + 1
    rows = [(big + 2 * i, None if i == 9 else big + i, start + timedelta(hours=h), kind) for i in range(10) for h, kind in ((2, "listed"), (1, "deleted"), (0, "listed"))]
    rows += [(None, big, start + timedelta(hours=3), "listed"), (5, big, None, "listed")]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, kind string")
    parts = [events.where("kind = 'listed'"), events.where("kind = 'deleted'"), *(closing(events, "user_id", days) for days in (10, 20))]
    with in_order.rocks_state(spark):
        found = run_to_end(spark, feed(spark, parts), lambda s: jobs.shown(s, "user_id", "12 hours"), mode="append", files=1).collect()
    hour = lambda r: round((r.at - min(f.at for f in found)) / 3.6e9)
    expected = [(None if i == 9 else big + i, big + 2 * i, h, a) for i in range(10) for h, a in ((0, "shown"), (2, "hidden"))] + [(big, None, 3, "hidden")]
    assert sorted(map(str, ((r.user_id, r.event_id, hour(r), r.answer) for r in found))) == sorted(map(str, expected))


def test_a_part_of_a_feed_is_dealt_to_files(spark, sf_dir, monkeypatch):
    """no task writes or reads a whole part of the events; every part and closing row has as many files, whatever is a micro-batch."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 30, raising=False)
    sources = []
    monkeypatch.setattr(stream_queries, "run_to_end", lambda spark, source, *a, **k: sources.append((source, k)) or run_to_end(spark, source, *a, **k))
    assert_same(QUERIES["stream_import_jobs"](spark, sf_dir), sf_dir, ORACLES["stream_import_jobs"])
    [(source, given)] = sources
    sizes = [r["count"] for r in spark.read.parquet(source).groupBy(F.input_file_name()).count().collect()]
    assert given["files"] > 1 and len(sizes) == given["files"] * (stream_queries.FILES + 2) and max(sizes) < 60


class Asked(jobs.Tombstone):
    """Counts how often it is asked when it changes by itself."""

    times = 0

    def due(self, held):
        self.times += 1


class Held:
    """State as Spark hands it over."""

    def __init__(self, passed):
        self.get, self.exists, self.passed = None, False, passed

    def getCurrentWatermarkMs(self):
        return self.passed

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_a_machine_is_asked_when_it_changes_only_after_a_change():
    """events that wait stay in columns, and those that change nothing cost a machine one call."""
    machine, state = Asked(), Held(0)
    run = in_order.InOrder(machine, ["_key", "event_id", "at", "answer"])
    rows = pd.DataFrame({"_key": ["a"] * 400 + ["b"], "_keyed": True, "event_id": range(401), "_known": True, "_at": [*range(1000, 401_000, 1000), 9_000_000], "kind": ["deleted", *["listed"] * 399, None]})
    assert list(run((0,), iter([rows[:200], rows[200:]]), state)) == [] and machine.times == 0 and state.timeout == 1
    state.passed = 1000
    [said] = run((0,), iter([]), state)
    assert len(said) == 1 and said["event_id"][0] == list(range(1, 400)) and set(said["answer"][0]) == {"hidden"} and set(said["_key"][0]) == {"a"}
    assert machine.times <= 3 and state.timeout == 9000
    state.passed = 10_000
    assert list(run((0,), iter([]), state)) == [] and pickle.loads(state.get[0])[1] == {"a": (1000,)}
