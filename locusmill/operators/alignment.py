"""Translated fragments and the source sentences they stand for (JN-17, JN-19 to JN-21, WIN-10, WIN-12, AGG-04, AGG-15, ALN-02, ALN-03).

``sentences`` has paragraph_id, url, sentence_key, ordinal, start, stop and text: a paragraph of the
source. ``fragments`` has paragraph_id, url, frag_idx, sentence_key, text and is_reference: its
translation in pieces, each with the key of the sentence it came from, or none. ``selections`` has
selection_id, paragraph_id, start and stop: code points of the joined fragments.

Fragments and sentences are brought together once, as arrays in one row for each paragraph; groups and votes are
made in that row, and selections meet it by their paragraph. Only keys go elsewhere, to learn whether any paragraph has them.
Defined cases: fragments that are references or hold nothing but marks are left out; null texts count as empty; a paragraph
without fragments gives no row; a selection in no paragraph has no anchors; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.functions.text import coverage_key, page_address, text_of
from locusmill.functions.tokens import cjk_sentences
from locusmill.operators.spans import once, sums_of

#: Why a paragraph's groups can't be used, the first that holds; ``grouped`` if none does (A.9).
GROUP_REASONS = ("unknown-key", "foreign-owner", "stale-url", "noncontiguous-key", "source-order", "unmarked-content", "duplicated-translation")
SHARE, LEAD = 0.7, 8


def sentence_keys(paragraphs: DataFrame, spans: Column) -> DataFrame:
    """The sentences of paragraphs (paragraph_id, url, text), keyed by address, paragraph and ordinal (ALN-02). ``spans`` has start, stop and text."""
    each = paragraphs.select("paragraph_id", "url", F.posexplode(spans).alias("_i", "_s"))
    key = F.sha2(F.concat_ws("|", F.substring_index(text_of("url"), "#", 1), F.col("paragraph_id").cast("string"), (F.col("_i") + 1).cast("string")), 256)
    return each.select("paragraph_id", "url", F.left(key, F.lit(16)).alias("sentence_key"), (F.col("_i") + 1).alias("ordinal"), "_s.start", "_s.stop", "_s.text")


def _usable() -> Column:
    return ~F.coalesce("is_reference", F.lit(False)) & (coverage_key("text") != "")


def _of_key(sentences: Column, key: Column) -> Column:
    return F.filter(sentences, lambda s: s["sentence_key"] == key)


def _distinct(items: Column, value) -> Column:
    return F.array_distinct(F.transform(items, value))


def _voted(unit: Column, pieces: Column) -> Column:
    """The key that has ``SHARE`` of a unit's characters and leads by ``LEAD``, else null; ties go to the smaller key."""
    over = lambda p: F.least(p["end"], unit["end"]) - F.greatest(p["at"], unit["at"])
    weight = lambda met, k: F.aggregate(F.filter(met, lambda p: p["sentence_key"] == k), F.lit(0), lambda n, p: n + over(p))
    ranked = lambda met: F.array_sort(F.transform(_distinct(met, lambda p: p["sentence_key"]), lambda k: F.struct((-weight(met, k)).alias("w"), k.alias("k"))))
    total = lambda r: F.aggregate(r, F.lit(0), lambda n, x: n - x["w"])
    first, second = (lambda r: -F.get(r, F.lit(0))["w"]), (lambda r: F.coalesce(-F.get(r, F.lit(1))["w"], F.lit(0)))
    won = lambda r: F.when((first(r) >= SHARE * total(r)) & (first(r) - second(r) >= LEAD), F.get(r, F.lit(0))["k"])
    met = F.filter(pieces, lambda p: p["sentence_key"].isNotNull() & (over(p) > 0))
    return once(met, lambda m: once(ranked(m), won))


def _steps(items: Column, holds) -> Column:
    """Whether ``holds`` is true of some entry and the one before it."""
    return F.exists(F.zip_with(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), holds), lambda x: F.coalesce(x, F.lit(False)))


def _paragraphs(fragments: DataFrame, sentences: DataFrame) -> DataFrame:
    """A row for each paragraph of ``fragments``: its sentences, its usable pieces with their places in the joined text, their groups, and what ``GROUP_REASONS`` holds.

    paragraph_id, sentences, text, pieces, groups, wanted (how many keys its sentences have) and reason (null if no group has one).
    """
    piece = F.struct("frag_idx", "sentence_key", page_address("url").alias("url"), text_of("text").alias("t"), _usable().alias("usable"))
    # Keys that no paragraph has.
    marked = fragments.where(_usable() & F.col("sentence_key").isNotNull()).select("paragraph_id", "sentence_key")
    strange = marked.join(sentences.select("sentence_key"), "sentence_key", "left_anti").select("paragraph_id", F.lit(True).alias("_unknown"))
    cut = fragments.select("paragraph_id", piece.alias("_p")).unionByName(strange, allowMissingColumns=True)
    cut = cut.groupBy("paragraph_id").agg(F.array_sort(F.collect_list("_p")).alias("_f"), F.max("_unknown").alias("_unknown"))
    at = sums_of(F.transform("_f", lambda p: F.length(p["t"]).cast("bigint")))
    spot = lambda p, a: F.struct(p["sentence_key"].alias("sentence_key"), p["url"].alias("url"), p["t"].alias("t"), p["usable"].alias("usable"), a.cast("int").alias("at"), (a + F.length(p["t"])).cast("int").alias("end"))
    cut = cut.select("paragraph_id", "_unknown", F.array_join(F.transform("_f", lambda p: p["t"]), "").alias("text"), F.filter(F.zip_with("_f", at, spot), lambda p: p["usable"]).alias("pieces"))
    said = F.struct("ordinal", "sentence_key", F.substring_index("url", "#", 1).alias("url"), "start", "stop", "text")
    known = sentences.groupBy("paragraph_id").agg(F.array_sort(F.collect_list(said)).alias("sentences"))
    rows = cut.join(known, "paragraph_id", "left")
    # Neighbouring pieces of one key are a group, which starts where the key changes.
    new = lambda p, i: (i == 0) | ~p["sentence_key"].eqNullSafe(F.get("pieces", i - 1)["sentence_key"])
    starts = F.filter(F.transform("pieces", lambda p, i: F.when(new(p, i), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    own = lambda i: F.get(_of_key(F.col("sentences"), F.get("pieces", i)["sentence_key"]), F.lit(0))
    stop = lambda g: F.coalesce(F.get("_starts", g + 1), F.size("pieces"))
    made = F.transform("_starts", lambda i, g: F.struct(
        F.get("pieces", i)["sentence_key"].alias("sentence_key"), F.slice("pieces", i + 1, stop(g) - i).alias("pieces"), own(i).alias("of"),
    ))
    rows = rows.withColumn("groups", made)
    keys = F.filter(F.transform("groups", lambda g: g["sentence_key"]), lambda k: k.isNotNull())
    texts = F.transform("groups", lambda g: coverage_key(F.array_join(F.transform(g["pieces"], lambda p: p["t"]), "")))
    # The last stop of the groups so far, and whether any starts before it.
    step = lambda s, g: F.struct(F.greatest(s["stop"], g["of"]["stop"]).alias("stop"), (s["back"] | F.coalesce(g["of"]["start"] < s["stop"], F.lit(False))).alias("back"))
    back = F.aggregate("groups", F.struct(F.lit(None).cast(sentences.schema["stop"].dataType).alias("stop"), F.lit(False).alias("back")), step, lambda s: s["back"])
    stale = F.exists("groups", lambda g: F.coalesce(F.exists(g["pieces"], lambda p: p["url"] != g["of"]["url"]), F.lit(False)))
    holds = (
        F.col("_unknown"), F.exists("groups", lambda g: g["sentence_key"].isNotNull() & g["of"]["ordinal"].isNull()), stale, once(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k)),
        back, F.exists("groups", lambda g: g["sentence_key"].isNull()), once(texts, lambda t: F.size(F.array_distinct(t)) < F.size(t)),
    )
    reason = F.coalesce(*(F.when(h, r) for h, r in zip(holds, GROUP_REASONS, strict=True)))
    wanted = F.size(F.array_compact(_distinct(F.col("sentences"), lambda s: s["sentence_key"])))
    return rows.select("paragraph_id", "sentences", "text", "pieces", "groups", F.when(F.col("sentences").isNotNull(), wanted).alias("wanted"), reason.alias("reason"))


def paragraph_verdicts(fragments: DataFrame, sentences: DataFrame) -> DataFrame:
    """paragraph_id, reason (``grouped`` if its groups can be used), whether every sentence has its group, and how many groups there are."""
    rows = _paragraphs(fragments, sentences).where(F.size("pieces") > 0)
    found = F.size(_distinct(F.filter("groups", lambda g: g["of"]["ordinal"].isNotNull()), lambda g: g["sentence_key"]))
    return rows.select("paragraph_id", F.coalesce("reason", F.lit("grouped")).alias("reason"), (found == F.coalesce("wanted", F.lit(0))).alias("complete"), F.size("groups").cast("bigint").alias("groups"))


def _units(rows: DataFrame, where: Column) -> DataFrame:
    """``rows`` of paragraphs with units: at, end and sentence_key of their translated sentences where votes decide all of them, else null (JN-20).

    A unit's key needs ``SHARE`` of its characters and a lead of ``LEAD``. A paragraph counts only
    if every unit is decided, the keys run in source order, and every source sentence has a unit.
    """
    length = lambda t: F.length(t).cast("bigint")
    spot = lambda t, a: F.struct(a.cast("int").alias("at"), (a + F.length(t)).cast("int").alias("end"))
    cut = rows.withColumn("_t", F.when(where, cjk_sentences(F.col("text"))))
    cut = cut.withColumn("_u", F.zip_with("_t", sums_of(F.transform("_t", length)), spot))
    cut = cut.withColumn("_u", F.transform("_u", lambda u: F.struct(u["at"].alias("at"), u["end"].alias("end"), _voted(u, F.col("pieces")).alias("sentence_key"))))
    cut = cut.withColumn("_o", F.transform("_u", lambda u: _of_key(F.col("sentences"), u["sentence_key"])))
    whole = (F.size("_u") > 0) & F.forall("_o", lambda o: F.size(o) == 1) & (F.size(_distinct(F.col("_u"), lambda u: u["sentence_key"])) == F.col("wanted"))
    forward = ~_steps(F.transform("_o", lambda o: F.get(o, F.lit(0))["ordinal"]), lambda now, before: now < before)
    return cut.withColumn("units", F.when(whole & forward, F.col("_u"))).drop("_t", "_u", "_o")


def interleaved(fragments: DataFrame, sentences: DataFrame) -> DataFrame:
    """paragraph_id, unit, at, end and sentence_key of translated sentences whose fragments vote for one source sentence (JN-20)."""
    rows = _units(_paragraphs(fragments, sentences), F.lit(True)).where("units is not null")
    return rows.select("paragraph_id", F.posexplode("units").alias("unit", "_u")).select("paragraph_id", "unit", "_u.*")


def captured(selections: DataFrame, fragments: DataFrame, sentences: DataFrame) -> DataFrame:
    """selection_id, reason, source and evidence: the source text of a selection, or why there is none (ALN-03).

    The reason is the first that holds: no-sentence-anchors, no-selected-sentence,
    invalid-sentence-fragment-groups, partial-sentence-boundary, uncovered-selection-text,
    noncontiguous-source; else captured. Of broken groups those that votes repair are used.
    """
    rows = _units(_paragraphs(fragments, sentences), F.col("reason").isin("noncontiguous-key", "source-order"))
    # The stretches of the translation and the sentence each stands for: fragments, or the units that votes gave.
    stretch = lambda p: F.struct(p["at"].alias("at"), p["end"].alias("end"), p["sentence_key"].alias("sentence_key"))
    rows = rows.select(
        "paragraph_id", "sentences", "wanted", F.coalesce("units", F.transform("pieces", stretch)).alias("stretches"), F.col("units").isNotNull().alias("_fixed"),
        F.exists("pieces", lambda p: p["sentence_key"].isNotNull()).alias("_anchored"), F.coalesce(F.coalesce("reason", F.lit("grouped")).isin("grouped", "unmarked-content"), F.lit(False)).alias("_sound"),
    )
    met = selections.select("selection_id", "paragraph_id", "start", "stop").join(rows, "paragraph_id", "left")
    over = lambda s: F.greatest(F.least(s["end"], F.col("stop")) - F.greatest(s["at"], F.col("start")), F.lit(0))
    total = lambda items, value: F.aggregate(items, F.lit(0).cast("bigint"), lambda n, s: n + value(s))
    held = lambda k: F.filter("stretches", lambda s: s["sentence_key"].eqNullSafe(k))
    fact = lambda k, own: F.struct(k.alias("key"), (total(own, over) < total(own, lambda s: s["end"] - s["at"])).alias("partial"))
    keys = _distinct(F.filter("stretches", lambda s: over(s) > 0), lambda s: s["sentence_key"])
    met = met.withColumn("_m", F.transform(keys, lambda k: once(held(k), lambda own: fact(k, own))))
    own = F.filter(F.flatten(F.transform("_m", lambda m: _of_key(F.col("sentences"), m["key"]))), lambda s: s["ordinal"].isNotNull())
    met = met.withColumn("_s", F.array_sort(F.transform(own, lambda s: F.struct(s["ordinal"].alias("ordinal"), s["text"].alias("text")))))
    met = met.withColumn("_n", F.coalesce(F.size("_s"), F.lit(0)))
    partial, unmarked = F.exists("_m", lambda m: m["partial"] & m["key"].isNotNull()), F.exists("_m", lambda m: m["key"].isNull())
    reason = (
        F.when(~F.coalesce("_anchored", F.lit(False)), "no-sentence-anchors").when(F.col("_n") <= 0, "no-selected-sentence").when(~(F.col("_sound") | F.col("_fixed")), "invalid-sentence-fragment-groups")
        .when(partial, "partial-sentence-boundary").when(unmarked, "uncovered-selection-text").when(_steps(F.col("_s"), lambda now, before: now["ordinal"] - before["ordinal"] > 1), "noncontiguous-source").otherwise("captured")
    )
    evidence = F.when(F.col("_n") == F.col("wanted"), "complete-validated-paragraph").when(F.col("_fixed"), "sentence-text-marker-consensus").otherwise("complete-captured-sentence-sequence")
    got = met.withColumn("_reason", reason)
    only = lambda c: F.when(F.col("_reason") == "captured", c)
    source = F.array_join(F.transform("_s", lambda s: F.trim(s["text"])), " ")
    return got.select("selection_id", F.col("_reason").alias("reason"), only(source).alias("source"), only(evidence).alias("evidence"))
