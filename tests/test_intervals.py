"""Intervals, differences, partitions and saved quotes against brute force, and their defined cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from locusmill.functions.text import figure_keys
from locusmill.operators import differences, intervals, partition, quotes

INTERVALS = "doc int, name int, start int, stop int"


def random_intervals(rng, n, longest):
    out = []
    for i in range(n):
        a = rng.randrange(400)
        out.append((rng.choice([1, 2, None]), i, a, a + rng.randrange(longest)))
    return out + [(1, n, None, 5), (1, n + 1, 7, 7)]


@pytest.mark.parametrize("width", [7, 512])
def test_overlaps_and_what_is_left(spark, width):
    rng = random.Random(width)
    one, two = random_intervals(rng, 60, 90), random_intervals(rng, 60, 25)
    two += two[:5]
    left = spark.createDataFrame(one, INTERVALS)
    right = spark.createDataFrame(two, INTERVALS)
    met = intervals.overlaps(left, right.select("doc", F.col("name").alias("other"), F.col("start").alias("from"), F.col("stop").alias("to")), "doc", width)
    fine = lambda r: None not in r and r[2] < r[3]
    want = [(a[1], b[1]) for a in one for b in two if fine(a) and fine(b) and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r.name, r.other) for r in met.collect()) == sorted(want)

    rest = {}
    for r in intervals.subtracted(left.withColumn("extra", F.lit(1)), right, "doc", "name").orderBy("part").collect():
        rest.setdefault(r.name, []).append((r.start, r.stop))
    for doc, name, a, b in filter(lambda r: None not in r[1:] and r[2] < r[3], one):
        free = [x for x in range(a, b) if not any(d == doc and doc is not None and None not in (s, e) and s <= x < e for d, _, s, e in two)]
        runs = [(x, next(y for y in range(x + 1, b + 1) if y not in free)) for x in free if x - 1 not in free]
        assert rest.pop(name, []) == runs
    assert not rest


def test_reference_gaps(spark):
    rows = [(" [7, 12] ", True), ("", True), (" 7–12", True), ("[8]", False), ("7a", False), ("，、7", True), (None, None)]
    df = spark.createDataFrame(rows, "gap string, holds boolean")
    assert [r.x for r in df.select(intervals.reference_gap(F.col("gap"), F.array(F.lit("7"), F.lit("12"))).alias("x")).collect()] == [h for _, h in rows]


ROWS = "k int, a string, b double, c array<int>"


def test_differences_of_multisets(spark):
    rng = random.Random(2)
    make = lambda: (rng.choice([None, *range(25)]), rng.choice([None, "", "x"]), rng.choice([None, 1.5]), rng.choice([None, [], [1]]))
    old, new = [make() for _ in range(60)], [make() for _ in range(60)]
    new += old[:30]
    found = {r.k: r for r in differences.differences(spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS).select("c", "b", "a", "k"), ["k"]).collect()}
    assert set(found) == {r[0] for r in old + new}
    for k, r in found.items():
        mine, theirs = ([x[1:] for x in rows if x[0] == k] for rows in (old, new))
        same = sorted(map(repr, mine)) == sorted(map(repr, theirs))
        assert (r.n_old, r.n_new) == (len(mine), len(theirs))
        assert r.status == ("added" if not mine else "removed" if not theirs else "kept" if same else "changed")
        if len(mine) == len(theirs) == 1:
            assert r.fields == [n for n, x, y in zip("abc", mine[0], theirs[0]) if x != y]
    one = spark.createDataFrame(old, ROWS)
    assert differences.same_rows(one, one.repartition(7, "a")) and not differences.same_rows(one, one.union(one.limit(1)))
    assert differences.same_rows(one.limit(0), one.where("false")) and not differences.same_rows(one, one.drop("a"))
    with pytest.raises(ValueError, match="same columns"):
        differences.differences(one, one.drop("a"), ["k"])


def brute_partitions(pieces, wanted):
    """Every way to give each part a stretch of pieces, in order, with its key."""
    if not wanted:
        return [[]] if not pieces else []
    out = []
    for n in range(1, len(pieces) + 1):
        if "|".join(k for k in pieces[:n] if k) == wanted[0]:
            out += [[n, *(n + x for x in rest)] for rest in brute_partitions(pieces[n:], wanted[1:])]
    return out


def test_partitions_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(250):
        keys = [rng.choice(["", "", "1", "2", "3", "1a"]) for _ in range(rng.randrange(1, 17))]
        cuts = sorted(rng.sample(range(1, len(keys)), min(len(keys) - 1, rng.randrange(1, 6)))) if len(keys) > 1 else []
        wanted = ["|".join(k for k in keys[a:b] if k) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        if rng.random() < 0.2:
            rng.shuffle(wanted)
        rows.append((i, keys, wanted))
    text = lambda ks, mark: " and ".join(f"{mark}{k}" for k in ks.split("|") if k)
    table = [(i, "".join(f"见{text(w, '图')}。" for w in wanted), ", which ".join(f"see {text(k, 'Fig. ')}" for k in keys)) for i, keys, wanted in rows]
    table += [(900, None, "x"), (901, "图1。图2。", None), (902, "图1。图2。more", "Fig. 1, but Fig. 2"), (903, "图1。", "Fig. 1")]
    df = spark.createDataFrame(table, "id int, translation string, source string")
    found = {}
    for r in partition.aligned_parts(df, "id", "translation", "source", F.lit(True)).orderBy("part").collect():
        found.setdefault(r.id, []).append((r.source, r.start, r.stop))
    unique = 0
    for i, keys, wanted in rows:
        ways = brute_partitions(keys, wanted) if 2 <= len(wanted) <= 6 and all(wanted) and len(set(wanted)) == len(wanted) else []
        assert (i in found) == (len(ways) == 1), (keys, wanted)
        if i in found:
            unique += 1
            sizes = [b - a for a, b in zip([0, *ways[0]], ways[0])]
            assert [s.count("see") for s, _, _ in found[i]] == sizes
            assert "".join(table[i][1][a:b] for _, a, b in found[i]) == table[i][1]
    assert unique > 20 and not {900, 901, 902, 903} & set(found)
    assert df.limit(1).select(figure_keys("translation")).count() == 1


def test_runs_of_sentences_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(12)]
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(14))]) for i in range(30)] + [(99, []), (98, [""] * 4)]
    asked = []
    for i in range(120):
        s = rng.choice(docs[:30])[1]
        a = rng.randrange(len(s) + 1)
        key = "".join(s[a : a + rng.randrange(1, 14)])
        asked.append((i, key if rng.random() < 0.8 else key[1:]))
    asked += [(200, None), (201, ""), (202, asked[0][1])]
    found = quotes.sentence_runs(spark.createDataFrame(asked, "quote_id int, key string"), spark.createDataFrame(docs, "doc_id int, sentences array<string>")).collect()
    want = set()
    for q, key in asked:
        for d, s in docs:
            if key and len(key) >= 12:
                starts = {len("".join(s[:x])) for x in range(len(s) + 1)}
                want |= {(q, d, a, a + len(key)) for a in starts if a + len(key) in starts and "".join(s)[a : a + len(key)] == key}
    assert sorted((r.quote_id, r.doc_id, r.start, r.stop) for r in found) == sorted(want) and len(want) > 20
    by_id = dict(docs)
    for r in found:
        assert "".join(by_id[r.doc_id][r.first : r.last + 1]) == dict(asked)[r.quote_id]
