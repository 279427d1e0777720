"""Finding quoted passages in texts, ranking the findings by their context, and what they say
(JN-01 to JN-03, JN-05, WIN-04, WIN-06, WIN-14, SRT-01, SRT-03, SRT-04, AGG-01, AGG-12).

Selectors and pages meet through an equi-join on a key that every page with the quote must hold:
up to ``GRAM`` inner words of the quote, the last character before and the first character behind
them; of all such runs of a quote the one that fewest pages hold. A quote of two words has no inner word and is keyed by the characters around its space, one
of a single word by runs of its characters; of a page only every ``STEP``-th long run is a key, so a long quote has a rarest one for each way
it may lie between them. No quote is held against every page, and each text is cut into words once.

Defined cases: a null or empty quote is found nowhere; null contexts count as empty; a null text
holds nothing; repeated selectors and pages are found as often as they are repeated; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.functions import projection
from locusmill.functions.tokens import char_grams, char_run_hashes, run_hashes
from locusmill.operators.spans import band_matches, offsets_of
from locusmill.sources.tables import saved

GRAM = 3
#: Characters of the keys of a long text of one word; three in a row are on nearly every page.
LONG = 8
#: From one key of a page to the next where quotes are long enough to hold a whole one wherever they begin.
STEP = 5
#: Runs of ``LONG`` characters at every ``STEP``-th place.
BLOCK = rf"(?s)(?=(.{{{LONG}}})).{{{STEP}}}"
#: Keys that may be broadcast; beyond them the join is left to shuffle.
MOST_BROADCAST = 200_000


def _word_keys(words: Column, inner: int) -> Column:
    """Of every run of ``inner`` words with a word on either side, the hash of them and of the characters next to them."""
    last, first = F.transform(words, lambda w: F.xxhash64(F.right(w, F.lit(1)))), F.transform(words, lambda w: F.xxhash64(F.left(w, F.lit(1))))
    whole = F.transform(words, lambda w: F.xxhash64(w))
    return run_hashes([last, *[whole] * inner, first], F.size(words))


def _keys(words: Column, text: Column, kind: str) -> Column:
    """The keys of one kind: ``w0`` to ``w3`` by inner words, ``c1`` to ``c3`` and ``c8`` by characters, ``b8`` by blocks of them."""
    size = int(kind[1])
    if kind[0] == "w":
        return _word_keys(words, size)
    if kind[0] == "b":
        return F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), lambda b: F.xxhash64(b))
    return char_run_hashes(text, 3) if size == 8 else F.transform(char_grams(text, size), lambda g: F.xxhash64(g))


def candidates(selectors: DataFrame, pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """selector_id, doc_id of pages that may hold a selector: those with the rarest of its keys.

    One pass over the pages makes the keys of all kinds in use and keeps those that a selector has.
    """
    words = F.split("text", " ", -1)
    n = F.size(words)
    # Spaces at an end of a quote have no word beside them; such a quote is keyed by its characters, too.
    long = F.length("text")
    chars = F.when(long >= LONG + STEP - 1, F.lit(f"b{LONG}")).otherwise(F.concat(F.lit("c"), F.when(long >= LONG, LONG).otherwise(F.least(long, F.lit(3)))))
    kind = F.when((n > 1) & ~F.regexp_like("text", F.lit(r"^ | \z")), F.concat(F.lit("w"), F.least(n - 2, F.lit(GRAM)))).otherwise(chars)
    asked = selectors.where(F.length("text") > 0).select("selector_id", "text", words.alias("_words"), kind.alias("kind"))
    used = sorted(name for (name,) in asked.select("kind").distinct().collect())  # nine kinds at most
    if not used:
        return selectors.select("selector_id", F.lit(None).cast(pages.schema["doc_id"].dataType).alias("doc_id")).where("false")

    def keyed(name: str, skip: int = 0) -> Column:
        text = F.substring("text", skip + 1, 1 << 30) if skip else F.col("text")
        return F.transform(_keys(F.col("_words"), text, name), lambda k: F.xxhash64(F.lit(name), k))

    # A page with the quote holds all keys of one of its parts: blocks lie in it as they do from one of ``STEP`` places on.
    own = F.coalesce(*(F.when(F.col("kind") == name, F.array(*(keyed(name, i) for i in range(STEP if name[0] == "b" else 1)))) for name in used))
    parts = asked.select("selector_id", F.posexplode(own).alias("part", "keys"))
    keys = saved(parts.select("selector_id", "part", F.explode(F.array_distinct("keys")).alias("key")), "locate-keys")
    wanted = keys.select("key").distinct()
    few = wanted.limit(most_broadcast + 1).count() <= most_broadcast
    # An outer explode: from a plain one a filter on the array's size is inferred and the array made twice.
    made = pages.select("doc_id", "text", words.alias("_words")).select("doc_id", F.explode_outer(F.array_distinct(F.concat(*map(keyed, used)))).alias("key"))
    met = saved(made.join(F.broadcast(wanted) if few else wanted, "key", "left_semi"), "locate-met")
    # A key that no page has says that none holds the quote so.
    counts = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = keys.join(counts if few else counts.hint("merge"), "key", "left")
    rarest = counted.groupBy("selector_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("_k"))
    rarest = saved(rarest.where("_k.n > 0").select("selector_id", F.col("_k.key").alias("key")), "locate-rarest")
    # Files of keys are small and their rows many: what is met is never sent to the driver, whatever its files' size.
    some = rarest.limit(most_broadcast + 1).count() <= most_broadcast
    return (F.broadcast(rarest) if some else rarest).join(met if some else met.hint("merge"), "key").select("selector_id", "doc_id").distinct()


def _holding(selectors: DataFrame, pages: DataFrame, most_broadcast: int) -> DataFrame:
    """Selectors beside the pages that hold them: selector columns (text as quote), doc_id and text."""
    both = candidates(selectors, pages, most_broadcast).join(pages.select("doc_id", "text"), "doc_id")
    return both.join(selectors.withColumnRenamed("text", "quote"), "selector_id").where(F.contains("text", "quote"))


def located(selectors: DataFrame, pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """selector_id, doc_id, first_at (code points), n_found, for every page that holds a selector.

    ``selectors`` has selector_id and text, ``pages`` doc_id and text, both normalised.
    """
    both = _holding(selectors.select("selector_id", "text"), pages, most_broadcast)
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / F.length("quote")
    return both.select("selector_id", "doc_id", (F.instr(F.col("text"), F.col("quote")) - 1).alias("first_at"), n.cast("int").alias("n_found"))


def places(selectors: DataFrame, pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """selector_id, doc_id, at and length of every exact place; ``selectors`` and ``pages`` as for ``located``."""
    both = _holding(selectors.select("selector_id", "text"), pages, most_broadcast)
    return both.select("selector_id", "doc_id", F.explode(offsets_of(F.col("text"), F.col("quote"))).alias("at"), F.length("quote").alias("length"))


def raw_places(found: DataFrame, projected: DataFrame) -> DataFrame:
    """``places`` with start and stop in the raw text, which ``projected`` (doc_id, raw, projection) has beside its projection; and raw."""
    ranges = found.join(projected, "doc_id").withColumn("_r", projection.back(F.col("projection.maps"), F.col("at"), F.col("at") + F.col("length")))
    return ranges.select(*found.columns, "_r.start", "_r.stop", "raw")


def verdicts(selectors: DataFrame, found: DataFrame) -> DataFrame:
    """selector_id, status, n_places and doc_id; only a unique place is named."""
    places = found.groupBy("selector_id").agg(F.sum("n_found").alias("n"), F.min("doc_id").alias("at"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return selectors.select("selector_id").join(places, "selector_id", "left").select(
        "selector_id", F.when(n == 0, "not-found").when(n == 1, "unique").otherwise("ambiguous").alias("status"),
        n.alias("n_places"), F.when(n == 1, F.col("at")).alias("doc_id"),
    )


def ranked(selectors: DataFrame, pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every place of every selector: selector_id, doc_id, at, length, score and method.

    ``selectors`` has selector_id, text, prefix and suffix, ``pages`` doc_id and text, all normalised.
    An exact place scores 1, and 0.5 more for each side on which the context given stands next to it.
    Only on pages without an exact place do runs count that begin and end as the quote does, at 0.75.
    """
    asked = selectors.select("selector_id", "text", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    places = _holding(asked, pages, most_broadcast).withColumn("at", F.explode(offsets_of(F.col("text"), F.col("quote"))))
    end, before, behind = F.col("at") + F.length("quote"), F.length("prefix") * 2 + 8, F.length("suffix") * 2 + 8
    from_ = F.greatest(F.col("at") - before, F.lit(0))
    left = F.when(F.col("prefix") != "", F.endswith(F.trim(F.substring("text", (from_ + 1).cast("int"), (F.col("at") - from_).cast("int"))), F.col("prefix"))).otherwise(False)
    right = F.when(F.col("suffix") != "", F.startswith(F.trim(F.substring("text", (end + 1).cast("int"), behind)), F.col("suffix"))).otherwise(False)
    score = 1 + 0.5 * left.cast("int") + 0.5 * right.cast("int")
    exact = places.select("selector_id", "doc_id", "at", F.length("quote").alias("length"), score.cast("double").alias("score"), F.lit("exact").alias("method"))

    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens")
    bands = band_matches(asked.select("selector_id", words), pages.select("doc_id", words))
    bands = bands.join(exact.select("selector_id", "doc_id").distinct(), ["selector_id", "doc_id"], "left_anti")
    bands = bands.join(pages.select("doc_id", "text"), "doc_id")
    # Where a token begins: what stands before the n-th match of a word.
    gaps = F.transform(F.split("text", r"[\p{L}\p{N}]+", -1), lambda g: F.length(g))
    sizes = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t))
    total = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda s, x: s + x)
    at = total(gaps, F.col("first") + 1) + total(sizes, F.col("first"))
    stop = total(gaps, F.col("last") + 1) + total(sizes, F.col("last") + 1)
    loose = bands.select("selector_id", "doc_id", at.alias("at"), (stop - at).alias("length"), F.lit(0.75).alias("score"), F.lit("fragment").alias("method"))
    return exact.unionByName(loose)


def in_order(found: DataFrame, most: int | None = None) -> DataFrame:
    """``ranked`` with the place of each finding among its selector's: by score, page and offset; all, or the first ``most``."""
    order = W.partitionBy("selector_id").orderBy(F.desc("score"), "doc_id", "at")
    placed = found.withColumn("place", F.row_number().over(order))
    return placed if most is None else placed.where(F.col("place") <= most)


def best_only(found: DataFrame, least: float = 0.97) -> DataFrame:
    """Findings after two sieves: if any scores ``least``, only such stay; if the best is above 1, only its equals."""
    best = F.max("score").over(W.partitionBy("selector_id"))
    kept = found.withColumn("_best", best).where((F.col("_best") < least) | (F.col("score") >= least))
    return kept.where((F.col("_best") <= 1) | (F.col("score") == F.col("_best"))).drop("_best")


def settled(selectors: DataFrame, found: DataFrame) -> DataFrame:
    """selector_id, status, n_places, and place and score where it is unique."""
    places = found.groupBy("selector_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at", "length", "score", "method")).alias("one"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    one = lambda name: F.when(n == 1, F.col(f"one.{name}")).alias(name)
    return selectors.select("selector_id").join(places, "selector_id", "left").select(
        "selector_id", F.when(n == 0, "not-found").when(n == 1, "unique").otherwise("ambiguous").alias("status"), n.alias("n_places"),
        *map(one, ("doc_id", "at", "length", "score", "method")),
    )
