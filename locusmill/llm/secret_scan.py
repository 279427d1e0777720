"""Secret scan with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Base spans come from three patterns. The method then looks at every candidate value of the
corpus, base or not: its hash is counted by distinct repositories (texts of an owner) and distinct
owners (sources). Values of many owners or many repositories are copied examples; values of few are
owner-specific and look live. Base spans always stay; long mixed tokens outside of them are added
as kind ``owned`` only when their value is owner-specific.

Aggregation by hash and owner runs on the map side first, so a value in a third of all documents
costs one row for each task. The way back to the documents joins on the value's hash, whose large
partitions Spark splits.

Defined cases: a null text counts as empty and has no spans; a null owner is an owner of its own;
rows with the same key are scanned apart; an empty table gives no rows. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import saved, text_mark
from locusmill.operators.spans import count_up_to, sums_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group that holds the value, its least length (of the whole match for group 0).
BASE_KINDS = {"assign": (ASSIGN, 1, 8), "access": (r"AKIA[A-Z0-9]{12,}+", 0, 16), "hex": (r"[0-9a-f]{32,}+", 0, 32)}
#: A run of token characters, with single dots inside; its length, a letter and a digit are asked for afterwards.
LOOSE = r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-][.])(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]++(?:[.][A-Za-z0-9+/_=-]++)*+"
MAX_OWNERS = 2
MAX_REPOSITORIES = 20

_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,hash:bigint>>"


def _found(text: str, pattern: str, group: int, least: int, kind: str, rank: int) -> tuple[Column, Column, Column]:
    """Matches, values, and the pieces of text between the matches; leftmost, not overlapping."""
    return (
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        F.split(text, pattern, -1),
    )


def _positions(name: str, least: int, kind: str, rank: int) -> Column:
    """Spans from the lengths of pieces and matches, which alternate; in the order of the text, and disjoint."""
    sized = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
    before = sums_of(F.zip_with(f"_{name}_pieces", f"_{name}_all", lambda piece, match: sized(piece) + sized(match)))
    rows = F.arrays_zip(F.col(f"_{name}_pieces").alias("piece"), F.col(f"_{name}_all").alias("all"), F.col(f"_{name}_value").alias("value"), before.alias("at"))

    def span(row: Column) -> Column:
        start = (row["at"] + F.length(row["piece"])).cast("int")
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(row["all"])).alias("stop"),
            F.lit(kind).alias("kind"), F.xxhash64(row["value"]).alias("hash"),
        )

    def fits(row: Column) -> Column:
        long = F.coalesce(F.length(row["value"]) >= least, F.lit(False))
        return long & F.regexp_like(row["value"], F.lit("[0-9]")) & F.regexp_like(row["value"], F.lit("[A-Za-z]")) if kind == "owned" else long

    return F.when(F.size(f"_{name}_all") > 0, F.transform(F.filter(rows, fits), span)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _apart_from(spans: str):
    """Whether a span overlaps none of ``spans``, which are sorted and disjoint: the last that starts before its stop is found by bisection."""

    def apart(s: Column) -> Column:
        n = count_up_to(F.col(spans), s["stop"], lambda e: e["start"], strict=True)
        return F.coalesce(F.get(F.col(spans), n - 1)["stop"] <= s["start"], F.lit(True))

    return apart


def _listed(spans: str | Column) -> Column:
    column = F.col(spans) if isinstance(spans, str) else spans
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


def candidate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per document: _row, _key, _owner, _mark (of the text), base and loose (arrays of spans)."""
    kinds = {**BASE_KINDS, "owned": (LOOSE, 0, 20)}
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(owner).alias("_owner"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    matched = {}
    for rank, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        for name, column in zip(("all", "value", "pieces"), _found("_text", pattern, group, least, kind, rank), strict=True):
            matched[f"_{kind}_{name}"] = column
    for kind in kinds:  # the pieces are only cut where something matches
        matched[f"_{kind}_pieces"] = F.when(F.regexp_like("_text", F.lit(kinds[kind][0])), matched[f"_{kind}_pieces"])
    rows = rows.select("_row", "_key", "_owner", text_mark("_text").alias("_mark"), *(c.alias(n) for n, c in matched.items()))
    spans = {kind: _positions(kind, least, kind, rank) for rank, (kind, (_, _, least)) in enumerate(kinds.items())}
    rows = rows.select("_row", "_key", "_owner", "_mark", *(c.alias(f"_{k}") for k, c in spans.items()))
    base = F.array_sort(F.concat(*(F.col(f"_{k}") for k in BASE_KINDS)))
    clear = F.col("_owned")
    for kind in BASE_KINDS:
        clear = F.when(F.size(f"_{kind}") > 0, F.filter(clear, _apart_from(f"_{kind}"))).otherwise(clear)
    return rows.select("_row", "_key", "_owner", "_mark", base.alias("base"), clear.alias("loose"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners over all candidates (columns _mark, _owner, hash).

    Copies of a text within one owner count once.
    """
    by_owner = candidates.groupBy("hash", "_owner", "_mark").agg(F.lit(1).alias("one"))
    by_owner = by_owner.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: ``key``, base and added (arrays of spans), n_live, n_copied.

    n_live and n_copied count the base spans whose value is owner-specific or widely copied.
    """
    rows = saved(candidate_spans(docs, key, text, owner), "secret-spans")
    each = rows.select("_row", "_owner", "_mark", F.explode(F.concat("base", "loose")).alias("span"))
    each = each.select("_row", "_owner", "_mark", "span", F.col("span.hash").alias("hash"))
    verdicts = ownership(each).select(
        "hash", ((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).alias("live")
    )
    judged = each.join(verdicts, "hash").groupBy("_row").agg(
        F.collect_list(F.when((F.col("span.kind") == "owned") & F.col("live"), F.col("span"))).alias("added"),
        F.count_if((F.col("span.kind") != "owned") & F.col("live")).alias("n_live"),
        F.count_if((F.col("span.kind") != "owned") & ~F.col("live")).alias("n_copied"),
    )
    return rows.join(judged, "_row", "left").select(
        F.col("_key").alias(key), "base",
        F.coalesce(F.array_sort("added"), F.expr(f"cast(array() as {_SPANS})")).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        key, *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied",
    )
