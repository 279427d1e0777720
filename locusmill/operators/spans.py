"""Places inside texts: occurrences, token runs, pages of offsets and islands (WIN-01, WIN-02, WIN-14, WIN-15, JN-04, JN-06, JN-07).

Offsets are code points. Token runs meet their pages through an equi-join on a few tokens and are
then compared whole, so no quote is held against every page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a run that pages are joined on.
ANCHOR = 4


def _literal(phrase: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _few_sums(lengths: Column) -> Column:
    """The sums before each entry of a short array; the array grows entry by entry."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("before"))
    step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before"))
    return F.aggregate(lengths, start, step, lambda s: s["before"])


def sums_of(lengths: Column, skip: int = 0) -> Column:
    """The sums of all entries before each entry, but for the first ``skip``; ``lengths`` are bigint.

    Sums are taken in runs of the root of the array's size, so an array is copied as often as a run is long.
    """
    total = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda s, n: s + n)

    def by_runs(entries: Column, long: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(entries), F.lit(1)), long)
        runs = F.transform(starts, lambda i: F.slice(entries, i, long))
        sums = lambda runs: F.zip_with(runs, _few_sums(F.transform(runs, total)), lambda run, base: F.transform(_few_sums(run), lambda x: x + base))
        return F.flatten(once(runs, sums))

    all_ = once(lengths, lambda entries: by_runs(entries, F.greatest(F.ceil(F.sqrt(F.size(entries))).cast("int"), F.lit(1))))
    return once(all_, lambda sums: F.slice(sums, F.lit(skip + 1), F.size(sums))) if skip else all_


def once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is named; null for a null."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def offsets_of(text: Column, phrase: Column, overlapping: bool = False) -> Column:
    """An array of the offsets of a non-empty phrase in a text, both columns of one row; nothing leaves the row.

    The text is cut at the phrase and the lengths of the pieces are summed up. Overlapping ones are
    cut in front of, so that the next may begin inside. Null or empty: no offset.
    """
    pieces = F.split(text, F.concat(F.lit("(?="), _literal(phrase), F.lit(")")) if overlapping else _literal(phrase), F.lit(-1))
    step = F.lit(0) if overlapping else F.length(phrase)
    # The piece before each place ends there; a cut in front of the phrase at a text's very start leaves no empty piece.
    places = F.transform(sums_of(F.transform(pieces, lambda p: (F.length(p) + step).cast("bigint")), skip=1), lambda p: p - step)
    if overlapping:
        places = F.when(F.startswith(text, phrase), F.concat(F.array(F.lit(0).cast("bigint")), places)).otherwise(places)
    return F.coalesce(F.when(F.length(phrase) > 0, places), F.expr("cast(array() as array<bigint>)"))


def occurrences(rows: DataFrame, key: str, text: str, phrase: str | Column, overlapping: bool = False) -> DataFrame:
    """``key`` and offset of each occurrence of a non-empty phrase; null texts hold none, and rows of one key are apart."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return rows.select(key, F.explode(offsets_of(F.col(text), phrase, overlapping)).alias("offset"))


def split_bounds(rows: DataFrame, key: str, pieces: Column, index: str, gap: int = 1) -> DataFrame:
    """``key``, ``index``, start and end of each piece of a row's array of texts, ``gap`` code points apart. No shuffle."""
    cut = rows.select(key, pieces.alias("_pieces"))
    cut = cut.select(key, "_pieces", sums_of(F.transform("_pieces", lambda p: (F.length(p) + gap).cast("bigint"))).alias("_before"))
    each = cut.select(key, F.posexplode(F.arrays_zip("_pieces", "_before")).alias(index, "_p"))
    return each.select(key, index, F.col("_p._before").alias("start"), (F.col("_p._before") + F.length("_p._pieces")).alias("end"))


def page_slices(rows: DataFrame, key: str, text: str, counts: str) -> DataFrame:
    """``key``, page and text of a text cut by an array of character counts; what is left over goes to the last page (SRC-20)."""
    before = sums_of(F.transform(counts, lambda c: F.coalesce(c, F.lit(0)).cast("bigint")))
    cut = rows.select(key, F.col(text).alias("_text"), F.size(counts).alias("_n"), F.posexplode(F.arrays_zip(F.col(counts).alias("n"), before.alias("at"))).alias("page", "_p"))
    length = F.when(F.col("page") == F.col("_n") - 1, F.length("_text")).otherwise(F.coalesce(F.col("_p.n"), F.lit(0)))
    return cut.select(key, "page", F.substring(F.col("_text"), (F.col("_p.at") + 1).cast("int"), length.cast("int")).alias("text"))


#: Steps that find a place among fewer than 2^26 entries.
_STEPS = [1 << i for i in range(25, -1, -1)]


def count_up_to(entries: Column, x: Column, value=lambda e: e, strict: bool = False) -> Column:
    """How many entries of a sorted array are at most ``x`` (``strict``: less), by bisection."""

    def further(n: Column, step: Column) -> Column:
        entry = value(F.get(entries, n + step - 1))
        return F.when((entry < x) if strict else (entry <= x), n + step).otherwise(n)

    return F.aggregate(F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s <= F.size(entries)), F.lit(0), further)


def pages_of(offsets: DataFrame, bounds: DataFrame, key: str, index: str) -> DataFrame:
    """Offsets (``key``, offset) with the page that ends behind them first; null past the end. Pages of a key are in order of ``index``."""
    ends = bounds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("_i"), F.col("end").alias("_end")))).alias("_ends"))
    page = F.get("_ends", count_up_to(F.col("_ends"), F.col("offset"), lambda e: e["_end"]))["_i"]
    return offsets.select(key, "offset").distinct().join(ends, key, "left").select(key, "offset", page.alias(index))


def token_starts(selectors: DataFrame, pages: DataFrame) -> DataFrame:
    """selector_id, doc_id, start: every place where a selector's tokens stand in a row.

    ``selectors`` has selector_id and tokens, ``pages`` doc_id and tokens. A selector without tokens stands nowhere.
    """
    wanted = selectors.select("selector_id", F.col("tokens").alias("quote")).where(F.size("quote") > 0)
    found = None
    for size in range(1, ANCHOR + 1):
        some = wanted.where(F.size("quote") >= size if size == ANCHOR else F.size("quote") == size)
        keys = some.select("selector_id", F.xxhash64(F.array_join(F.slice("quote", 1, size), " ")).alias("gram"))
        # An outer explode: from a plain one a filter on the array's size is inferred, which cuts a text again for each of its runs.
        runs = pages.select("doc_id", F.posexplode_outer(F.when(F.size("tokens") >= size, _grams(size))).alias("start", "gram"))
        met = runs.join(keys, "gram").select("selector_id", "doc_id", "start")
        found = met if found is None else found.union(met)
    both = found.join(wanted, "selector_id").join(pages.select("doc_id", "tokens"), "doc_id")
    same = F.slice("tokens", F.col("start") + 1, F.size("quote")) == F.col("quote")
    return both.where(same).select("selector_id", "doc_id", "start")


def _grams(size: int) -> Column:
    starts = F.sequence(F.lit(1), F.size("tokens") - size + 1)
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("tokens", i, size), " ")))


def band_matches(selectors: DataFrame, pages: DataFrame, least: int = 12, slack: int = 16) -> DataFrame:
    """selector_id, doc_id, first and last token of runs that begin and end as a quote does.

    Head and tail are up to seven tokens, a third of the quote; for each head the first tail behind
    it counts, and it must start within the quote's length and ``slack``.
    """
    size = F.least(F.lit(7), F.floor(F.size("tokens") / 3)).cast("int")
    asked = selectors.where(F.size("tokens") >= least).withColumn("k", size)
    heads = token_starts(asked.select("selector_id", F.slice("tokens", F.lit(1), F.col("k")).alias("tokens")), pages)
    tails = token_starts(asked.select("selector_id", F.slice("tokens", F.size("tokens") - F.col("k") + 1, F.col("k")).alias("tokens")), pages)
    both = heads.join(tails.withColumnRenamed("start", "tail"), ["selector_id", "doc_id"]).join(asked.select("selector_id", "k", F.size("tokens").alias("n")), "selector_id")
    near = both.where((F.col("tail") >= F.col("start") + F.col("k")) & (F.col("tail") - F.col("start") <= F.col("n") + slack))
    return near.groupBy("selector_id", "doc_id", F.col("start").alias("first")).agg((F.min("tail") + F.first("k") - 1).alias("last"))


def article_matches(selectors: DataFrame, pages: DataFrame, article: str = "the", least: int = 8, slack: int = 2) -> DataFrame:
    """selector_id, doc_id, first and last token of runs that equal a quote but for its articles (JN-10).

    Quotes of at least ``least`` other tokens; what the run is longer or shorter is at most ``slack``.
    """
    other = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda s: s["t"] != article)
    bare = lambda df, key: df.select(key, F.size("tokens").alias("n"), other.alias("_o"))
    asked = bare(selectors, "selector_id").where(F.size("_o") >= least).select("selector_id", "n", F.col("_o.t").alias("tokens"))
    held = bare(pages, "doc_id").select("doc_id", F.col("_o.t").alias("tokens"), F.col("_o.i").alias("places"))
    met = token_starts(asked, held).join(asked.select("selector_id", "n", F.size("tokens").alias("k")), "selector_id").join(held.select("doc_id", "places"), "doc_id")
    first, last = F.get("places", F.col("start")), F.get("places", F.col("start") + F.col("k") - 1)
    return met.where(F.abs(last - first + 1 - F.col("n")) <= slack).select("selector_id", "doc_id", first.alias("first"), last.alias("last"))


def islands(rows: DataFrame, keys: list[str], left: str, right: str, gap: Column) -> DataFrame:
    """Intervals of each key, in order of their left edge, joined where the gap isn't greater than ``gap``."""
    order = W.partitionBy(*keys).orderBy(left, right)
    new = F.coalesce(F.col(left) - F.lag(right).over(order) > gap, F.lit(True)).cast("int")
    marked = rows.withColumn("_new", new).withColumn("segment", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.min(left).alias("x0"), F.max(right).alias("x1"))
