"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Texts are lower-cased in A-Z and cut into words. A window is ``WINDOW`` consecutive words of a
benchmark item. Winnowing keeps of every window the ``GRAM``-word grams with its least hash (all of
them where several tie), so two equal windows always keep the same gram at the same place. About
two grams in seven are kept. Fingerprints of benchmark and documents are joined, and each hit is
extended word by word to both sides as far as a window that holds the gram can reach; what matches
over a whole window counts, and overlapping hits make up longer passages. An item shorter than a
window (but not empty) is one window of its own length; its hash is looked for at every place, for
all such lengths in the same pass.

The benchmark's side is broadcast only while it is counted to hold at most ``MOST_BROADCAST``
fingerprints, and then one pass over the corpus makes all hits. Beyond that, fingerprints alone go
through a shuffle, and the words around a hit are cut from the documents that have one.

Defined cases: a null text has no words; a document or item without words hits nothing; an item
repeated under several ids counts once for each id; rows with the same key are judged apart; an
empty table gives no rows; an empty benchmark hits nothing. Null item_ids read as ''. Texts of any
length are taken whole; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.bloom import drop_rows
from locusmill.llm.scratch import saved, text_mark

WINDOW = 10
GRAM = 5
MOST_BROADCAST = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-cased words, as an array."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def _tail(array: str, skip: int, length: Column) -> Column:
    return F.slice(F.col(array), F.lit(skip + 1), F.greatest(length, F.lit(0)))


def _widen(df: DataFrame, name: str, wide: int, upto: int, step: str, join) -> tuple[DataFrame, str]:
    """Arrays over runs of ``upto`` entries from arrays over runs of ``wide``, doubling at most."""
    while wide < upto:
        by = min(wide, upto - wide)
        new = f"_{step}{wide + by}"
        length = F.size(name) - by
        df = df.withColumn(new, F.zip_with(_tail(name, 0, length), _tail(name, by, length), join))
        name, wide = new, wide + by
    return df, name


def gram_hashes(df: DataFrame, gram: int) -> tuple[DataFrame, str]:
    """Adds an array of hashes of every run of ``gram`` words of column _words.

    Runs overlap where the length is no power of two; the hash still depends on all words alone.
    """
    df = df.withColumn("_gram1", F.transform("_words", lambda w: F.xxhash64(w)))
    return _widen(df, "_gram1", 1, gram, "gram", lambda a, b: F.xxhash64(a, b))


def seeds(df: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """Adds _seeds, an array of at, n and print: the kept grams of column _words and, for each length in ``short``, all runs."""
    wide, name = window - gram + 1, ""
    df, name = gram_hashes(df, gram)
    df, least = _widen(df, name, 1, wide, "least", lambda a, b: F.least(a, b))
    # A gram is the least of some window if the greatest of the minima of the windows that hold it is its own hash.
    edge = F.array_repeat(F.lit(-(2**63)).cast("bigint"), wide - 1)
    df = df.withColumn("_edged", F.concat(edge, F.col(least), edge))
    df, most = _widen(df, "_edged", 1, wide, "most", lambda a, b: F.greatest(a, b))
    own = F.transform(F.zip_with(name, most, lambda h, m: F.when(h == m, h)), lambda h, i: F.struct(i.alias("at"), F.lit(window).alias("n"), h.alias("print")))
    df = df.withColumn("_seeds", F.filter(own, lambda s: s["print"].isNotNull()))
    for n in short:
        df, name = gram_hashes(df, n)
        df = df.withColumn("_seeds", F.concat("_seeds", _all_seeds(name, n)))
    return df


def _all_seeds(hashes: str, n: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("n"), h.alias("print")))


def _around(seed: str, window: int, gram: int) -> list[Column]:
    """left and right: the words on both sides of a seed's start that a window which holds it can reach."""
    at, n, reach = F.greatest(F.col(f"{seed}.at"), F.lit(0)), F.col(f"{seed}.n"), window - gram
    left = F.when(n == window, F.least(at, F.lit(reach))).otherwise(0)
    return [F.slice("_words", at - left + 1, left).alias("left"), F.slice("_words", at + 1, n).alias("right")]


def _equal_run(a: Column, b: Column) -> Column:
    """How many entries two arrays share from their start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def benchmark_seeds(items: DataFrame, item_key: str, text: str, window: int, gram: int) -> DataFrame:
    """n, print, left, right and item of every fingerprint of the benchmark."""
    rows = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), words(text).alias("_words"))
    rows = saved(rows.where(F.size("_words") > 0).distinct(), "bench-words")
    parts = [_seed_rows(rows.where(F.size("_words") >= window), window, gram, [])]
    for (n,) in rows.where(F.size("_words") < window).select(F.size("_words")).distinct().collect():  # at most window - 1
        parts.append(_seed_rows(rows.where(F.size("_words") == n), window, gram, [n]).where(F.col("seed.at") == 0))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where("seed is not null").select("seed.n", "seed.print", *_around("seed", window, gram), "item").distinct()


def _seed_rows(rows: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    # An outer explode: from a plain one a filter on the array's size is inferred, and pushed below the chain with all of it inlined.
    return seeds(rows, window, gram, short).select("item", "_words", F.explode_outer("_seeds").alias("seed"))


def _row(key: str, text: str) -> Column:
    """Tells rows apart by key and text, which every pass finds again whatever the splits of its scan."""
    return F.concat_ws(":", F.col(key).cast("string"), text_mark(text).cast("string"))


def find_hits(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per document: ``key``, n_words, spans (sorted array of at and n, in words; they may overlap), items (array)."""
    base = docs.select(_row(key, text).alias("_row"), F.col(key).alias("_key"), words(text).alias("_words"))
    one, found = _found(base, items, item_key, item_text, window, gram, most_broadcast)
    return one.join(found, "_row", "left").select(
        F.col("_key").alias(key), "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,n:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _found(base: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int, gram: int, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """_row, _key, n_words of every row of ``base`` (_row, _key, _words); and _row, spans, items of those with a hit."""
    known = saved(benchmark_seeds(items, item_key, item_text, window, gram), "bench-seeds")
    small = known.count() <= most_broadcast
    near = F.broadcast if small else (lambda df: df)
    prints = known.select("n", "print").distinct().withColumn("known", F.lit(True))
    short = sorted(n for (n,) in known.where(F.col("n") < window).select("n").distinct().collect())

    # The entry before the first stands for the row itself, hit or not.
    self_ = F.expr("array(struct(-1 as at, 0 as n, cast(null as bigint) as print))")
    each = seeds(base, window, gram, short).withColumn("_seeds", F.concat(self_, "_seeds"))
    n_words = F.size("_words").cast("bigint").alias("n_words")
    if small:
        rows = each.select("_row", "_key", "_words", F.explode_outer("_seeds").alias("seed"))
        rows = rows.select("*", F.col("seed.n").alias("n"), F.col("seed.print").alias("print")).join(near(prints), ["n", "print"], "left")
        rows = rows.where("known or seed.at < 0").select("_row", "_key", n_words, "seed.at", "n", "print", *_around("seed", window, gram))
        passed = saved(rows, "bench-hits")
        hits, one = passed.where("at >= 0"), passed.where("at < 0")
    else:
        rows = saved(each.select("_row", F.explode_outer("_seeds").alias("seed")).select("_row", "seed.*"), "bench-prints")
        rows = rows.join(prints, ["n", "print"], "left_semi").distinct().groupBy("_row").agg(F.collect_list(F.struct("at", "n", "print")).alias("_seeds"))
        rows = base.join(rows, "_row").select("_row", "_words", F.explode_outer("_seeds").alias("seed"))
        hits = saved(rows.select("_row", "seed.*", *_around("seed", window, gram)), "bench-hits")
        one = base.select("_row", "_key", n_words)

    both = hits.join(near(known.withColumnsRenamed({"left": "_left", "right": "_right"})), ["n", "print"])
    before = _equal_run(F.reverse("left"), F.reverse("_left"))
    spans = both.select("_row", "item", "n", "at", before.alias("before"), _equal_run(F.col("right"), F.col("_right")).alias("after"))
    spans = spans.where("before + after >= n").select("_row", "item", F.struct((F.col("at") - F.col("before")).alias("at"), (F.col("before") + F.col("after")).alias("n")).alias("span"))
    found = spans.groupBy("_row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return one, found


def covered(spans: str) -> Column:
    """Words under any of the sorted spans."""

    def step(state: Column, span: Column) -> Column:
        stop = span["at"] + span["n"]
        more = F.greatest(F.lit(0), stop - F.greatest(span["at"], state["upto"]))
        return F.struct((state["total"] + more).alias("total"), F.greatest(stop, state["upto"]).alias("upto"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(F.col(spans), start, step, lambda s: s["total"].cast("bigint"))


def summary(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest for each document."""
    return hits.select(
        key, "n_words", covered("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold a window of the benchmark; columns stay as they are."""
    base = docs.select(_row(key, text).alias("_row"), F.col(key).alias("_key"), words(text).alias("_words"))
    _, found = _found(base, items, "item_id", "text", WINDOW, GRAM, MOST_BROADCAST)
    hit = saved(found.select(F.col("_row").alias("_mark")).distinct(), "bench-found")
    return drop_rows(docs, {"_mark": _row(key, text)}, hit)
