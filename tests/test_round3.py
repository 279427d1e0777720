"""Cases of the third round's findings, each of which failed before its mending."""

import pytest
from compare import assert_same

from locusmill.plans import ORACLES, QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    def made(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


def held_against_sql(spark, path, name):
    assert_same(QUERIES[name](spark, path), path, ORACLES[name])


def test_pages_of_single_letters_are_text(spark, folder):
    rows = [(1, "a " * 500), (2, "f r " * 250), (4, "x" * 400), (5, ("y" * 130 + " ") * 300), (6, None), (7, "")]
    held_against_sql(spark, folder(documents=(rows, "doc_id bigint, text string")), "figure_page_flag")


def test_headings_with_cut_references(spark, folder):
    rows = [(1, "<h1>a &amp;&amp;&amp</h1>"), (2, "<h1>&lt;b&gt; &amp;lt; &quot; &copy</h1>"), (3, "<h1>x & y</h1>"), (4, None)]
    held_against_sql(spark, folder(pages=(rows, "page_id bigint, html string")), "page_headings")


def test_items_of_one_title_are_met_as_one(spark):
    from pyspark.sql import functions as F

    from locusmill.operators import catalog

    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("10.5/abcdefg").alias("doi"), F.lit("one title").alias("title"), F.timestamp_seconds(F.col("id") % 50).alias("added"))
    asked = [(1, "10.5/abcdefg", None), (1, "10.5/abcdefg", None), (2, "cdefg", None), (3, "abcdefg", None), (4, "https://doi.org/10.5/ABCDEFG", None), (5, None, "one")]
    rows = catalog.resolved(spark.createDataFrame(asked, "request_id bigint, doi string, title string"), items)
    found = sorted({(r.request_id, r.tier, r.item_id, r.candidates) for r in rows.collect()})
    assert found == [(1, 1, 49, 20_000), (2, None, None, 0), (3, 2, 49, 20_000), (4, 1, 49, 20_000), (5, 3, 49, 20_000)]


def test_state_partitions_follow_the_rows():
    from locusmill.streaming.snapshots import state_partitions

    assert [state_partitions(n, 12) for n in (0, 10, 30_000, 600_000, 6_000_000, 36_000_000)] == [1, 1, 2, 12, 12, 72]


def test_shortlists_of_few_long_and_repeated_sentences(spark, folder):
    clause = lambda n, word: "".join(f"{word} {i}, and " for i in range(n))
    texts = [
        f"First one here. Second one here. {clause(60, 'long')}end.", f"{clause(60, 'long')}end. Chosen, which is short; but cut. Third one here.", "Same words here. " * 9,
        f"One of three. {clause(40, 'chosen')}end. Three of three, while it ends.", "Too short. No.", None, "", "a b c d e f. " * 40 + "which, it g. " * 40,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    held_against_sql(spark, folder(documents=(rows, "doc_id bigint, text string")), "whole_mapping_shortlist")


def test_only_spans_of_a_fitting_size_are_made(spark):
    from pyspark.sql import functions as F

    from locusmill.functions import tokens as K
    from locusmill.operators.spans import sums_of

    said = "".join(f"word {i}, and " for i in range(30)) + "end."
    row = spark.createDataFrame([(said,)], "t string").select("t", K.clauses(F.col("t")).alias("pieces"))
    parts = row.select("t", F.struct("pieces", sums_of(F.transform("pieces", lambda x: F.length(x).cast("bigint"))).alias("before")).alias("c"))
    every, some = parts.select(K.clause_spans(F.col("t")), K.sized_spans(F.col("c"), F.lit(40), F.lit(60))).first()
    assert {s for s in every if 40 <= len(s) <= 60} == {s for s in some if 40 <= len(s) <= 60}
    assert all(39 <= len(s) <= 62 for s in some) and len(some) < len(every) / 5


def test_tables_are_read_with_bounded_batches(spark, folder):
    from locusmill.sources import tables

    path, before = folder(documents=([(1, "a")], "doc_id bigint, text string")), spark.conf.get(tables.BATCH_SETTING, None)
    try:
        spark.conf.unset(tables.BATCH_SETTING)
        tables.table(spark, path, "documents")
        assert spark.conf.get(tables.BATCH_SETTING) == f"{8 << 20}b"
        spark.conf.set(tables.BATCH_SETTING, "1m")
        tables.table(spark, path, "documents")
        assert spark.conf.get(tables.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(tables.BATCH_SETTING) if before is None else spark.conf.set(tables.BATCH_SETTING, before)
