"""Near-duplicate detection by min-max hashing.

A document's set is its distinct shingles of words. Under each of ``PERMUTATIONS`` hash functions
both the least and the greatest value are kept, so that one evaluation gives two entries of the
signature; bands of ``ROWS`` entries, each from another function, are the buckets. Two sets of
Jaccard similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS: at 0.85 all but
2e-8 of pairs do, at 0.8 all but 4e-6. Every link is confirmed on the full sets.

Documents with equal sets are one class, represented once. First, every member
of a bucket meets its lead, the set that shares most with others (the original of a family of
copies, where there is one), and links join components. Then only buckets that span several
components are looked at: what lies outside the largest component meets the whole bucket. So
every pair of a bucket is linked, known to lie apart, or connected otherwise. No pairs are
emitted: members are dealt out once, by their size class and over salted blocks of some
``BLOCK_SHINGLES``; those outside are repeated for the blocks of their own and the neighbouring
size classes (others can't reach the threshold) and stream past them, and a block counts a set's
shingles against all of its own at once. No task holds more than a block.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of
fewer words than a shingle has its whole sequence as one; repeated rows and equal texts share a
component; a null key takes part but never names a component unless all its keys are null; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.bloom import drop_rows
from locusmill.llm.components import components
from locusmill.llm.scratch import Scratch, in_arrow, saved, text_mark, worker_memo

PERMUTATIONS = 48
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
GROUP = 128
BLOCK = 1024
BLOCK_SHINGLES = 300_000
WORDS_REMEMBERED = 100_000

_RANDOM = np.random.default_rng(20240607)
_TIMES = _RANDOM.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sets of hashed shingles; word hashes are remembered up to a bound."""

    def __init__(self, words: int) -> None:
        self.words = words
        self._hashes = _WordHashes()

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes. Case folds in A-Z alone; words end at 0x20 and 0x09-0x0D."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self._hashes) > WORDS_REMEMBERED:
            self._hashes.clear()
        hashes = np.fromiter(map(self._hashes.__getitem__, words), np.uint64, len(words))
        if len(hashes) < self.words:
            return _mixed((hashes * _PLACE[32 : 32 + len(hashes)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(hashes)))
        count = len(hashes) - self.words + 1
        total = hashes[:count] * _PLACE[0]
        for i in range(1, self.words):
            total = (total ^ (total >> np.uint64(29))) * _MIX + hashes[i : i + count] * _PLACE[i]
        total = _mixed(total)
        total.sort()
        return total[np.append(True, total[1:] != total[:-1])]


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """Bucket hashes of a set's min-max signature."""
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        y = shingles[start : start + BLOCK] ^ _FLIP[:, None]
        y *= _TIMES[:, None]
        y ^= y >> np.uint64(31)
        y *= _MIX
        np.minimum(least, y.min(1), out=least)
        np.maximum(most, y.max(1), out=most)
    half = BANDS // 2
    rows = np.concatenate([least.reshape(ROWS, half).T, most.reshape(ROWS, half).T])
    total = np.arange(BANDS, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        total = _mixed(total * _TIMES[r] + rows[:, r])
    return total.view(np.int64)


def _key_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """_key, mark (of the text), n (set size), set (its 128-bit digest; null where empty) and bands, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_memo(("shingles", words), lambda: Shingler(words))
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([bands_of(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["_key", "mark", "n", "set", "bands"],
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), text_mark(text).alias("mark"))
    return in_arrow(rows, run, f"_key {rows.schema[0].dataType.simpleString()}, mark bigint, n bigint, set binary, bands array<bigint>")


class _Block:
    """Some sets, against each of which another set is counted at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self._first = np.append(0, np.cumsum(self.sizes)[:-1])
        self._known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self._ids = ids.astype(np.int32)
        self._marks = np.zeros(len(self._known), np.int32)

    def linked(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets are linked with this one."""
        at = np.searchsorted(self._known, shingles)
        at[at == len(self._known)] = 0
        at = at[self._known[at] == shingles]
        self._marks[at] = 1
        common = np.add.reduceat(self._marks[self._ids], self._first)
        self._marks[at] = 0
        return 100 * common >= percent * (self.sizes + len(shingles) - common)


def _met(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (set, other, other_root) between the sides of each group, with different roots.

    ``rows`` has group columns ``place`` and ``salt``, side (0: held in memory, 1: streams past),
    set and root. A streaming set names one link for each other root it finds in a block.
    """
    asked = rows.join(texts, "set").select("place", "salt", "side", "set", "root", "_text")
    asked = asked.repartition("place", "salt").sortWithinPartitions("place", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at = worker_memo(("shingles", words), lambda: Shingler(words)), None
        names: list[tuple[bytes, bytes]] = []
        sets: list[np.ndarray] = []
        block = None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for place, salt, side, name, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = shingler.set_of(text)
                if _key_of(shingles) != name:
                    continue  # another row under the same key
                if at != (place, salt):
                    at, names, sets, block = (place, salt), [], [], None
                if side == 0:
                    names.append((name, root))
                    sets.append(shingles)
                elif names:
                    if block is None:
                        block, sets = _Block(sets), []
                    near: dict[bytes, bytes] = {}
                    for i in np.flatnonzero(block.linked(shingles, percent)):
                        near.setdefault(names[i][1], names[i][0])
                    near.pop(root, None)
                    found += [(name, other) for other in near.values()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["node", "root"])

    return in_arrow(asked, run, "node binary, root binary").distinct()


def _shared_buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, set, n, size and lead for buckets of several sets; of buckets with the same sets, one.

    Buckets count as having the same sets when their sizes and two sums of independent 64-bit
    hashes agree: 128 bits, as the digests of the sets themselves have.
    """
    members = scratch.saved(classes.select(F.explode("bands").alias("bucket"), "set", "n"), "near-bands")
    sums = [F.sum(F.xxhash64("set", F.lit(i)).cast("decimal(38,0)")).alias(f"mark{i}") for i in (0, 1)]
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *sums).where("size > 1")
    sizes = sizes.groupBy("size", "mark0", "mark1").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    shared = scratch.saved(members.join(sizes.select("bucket", "size", "times"), "bucket"), "near-buckets")
    # The original of a family shares more buckets with its copies than they do with each other.
    degrees = shared.groupBy("set").agg(F.sum(F.col("size") * F.col("times")).alias("degree"))
    leads = shared.join(degrees, "set").groupBy("bucket").agg(F.max(F.struct("degree", "set", "n")).alias("lead"))
    return scratch.saved(shared.join(leads.select("bucket", "lead"), "bucket").drop("times"), "near-led")


def _size_class(n: str | Column, percent: int) -> Column:
    """Sets that can be linked lie in the same class or in neighbouring ones."""
    width = math.log(100 / percent) * 1.001 if percent < 100 else 1e-9
    return F.floor(F.log(n) / width)


def link_sets(classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """node and root, for each linked class but the roots. ``classes``: set, label, n, bands."""
    with Scratch(classes.sparkSession) as scratch:
        return _linked(classes, docs, key, text, words, percent, scratch)


def _linked(classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    shared = _shared_buckets(classes, scratch)
    label = shared.select("set").distinct().join(classes.select("set", "label"), "set")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    texts = scratch.saved(label.join(texts, label["label"].eqNullSafe(texts["_key"])).select("set", "_text"), "near-texts")

    # Every member meets the lead of its bucket: the lead is held, its members stream past it.
    possible = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    led = shared.where(possible).where("set <> lead.set").select(F.col("lead.set").alias("place"), "set").distinct()
    groups = led.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    members = led.join(groups, "place").select("place", F.pmod(F.xxhash64("set"), "groups").alias("salt"), F.lit(1).alias("side"), "set", F.col("set").alias("root"))
    leads = groups.select("place", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("side"))
    leads = leads.select("*", F.col("place").alias("set"), F.col("place").alias("root"))
    links = scratch.saved(_met(members.union(leads), texts, words, percent), "near-links")
    roots = components(links)

    # A bucket that spans several components: what lies outside its largest one meets all of it.
    placed = shared.join(roots.withColumnRenamed("node", "set"), "set", "left").select("bucket", "set", "size", "n", F.coalesce("root", "set").alias("root"))
    placed = scratch.saved(placed, "near-placed")
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("part"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("part", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # The lead has met its bucket, so a bucket of two is decided.
    open_ = placed.where("size > 2").join(largest, "bucket").select(
        "bucket", _size_class("n", percent).alias("class"), "n", "set", "root", (F.col("root") != F.col("most.root")).alias("outside")
    )
    open_ = scratch.saved(open_, "near-open")
    outside = open_.where("outside").select("bucket", "set", "root", F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))).alias("class"))
    blocks = open_.groupBy("bucket", "class").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("groups"))
    blocks = scratch.saved(blocks.join(outside.select("bucket", "class").distinct(), ["bucket", "class"], "left_semi"), "near-blocks")
    place = F.struct("bucket", "class").alias("place")
    held = open_.join(blocks, ["bucket", "class"]).select(place, F.pmod(F.xxhash64("set"), "groups").alias("salt"), F.lit(0).alias("side"), "set", "root")
    passing = outside.join(blocks, ["bucket", "class"])
    passing = passing.select(place, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(1).alias("side"), "set", "root")
    more = scratch.saved(_met(held.union(passing), texts, words, percent), "near-links")
    return components(links.union(more))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept."""
    each, named = _placed(docs, key, text, words, percent)
    # Only classes with a null set are missing from ``named``; those documents stand alone.
    return each.join(named.drop("root"), "set", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("_key")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _placed(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and set, root and component_id of each class."""
    each = saved(sketches(docs, key, text, words), "near-sketches")
    filled = each.where("set is not null")
    classes = filled.groupBy("set").agg(F.min("_key").alias("label"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = saved(classes, "near-classes")
    roots = link_sets(classes, docs, key, text, words, percent)
    placed = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "label", F.coalesce("root", "set").alias("root"))
    return each, placed.join(placed.groupBy("root").agg(F.min("label").alias("component_id")), "root").select("set", "root", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest key; columns stay as they are.

    Of several texts of a group under that key the one with the smallest mark stays. Rows with the
    same key in different groups are judged apart.
    """
    each, named = _placed(docs, key, text, words, percent)
    first = each.join(named, "set").where(F.col("_key").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min(F.struct("_key", "mark")).alias("kept")).select("kept._key", "kept.mark")
    kept = first.union(each.where("set is null").select("_key", "mark")).distinct().toDF("_kept_key", "_kept_mark")
    same = each["_key"].eqNullSafe(kept["_kept_key"]) & (each["mark"] == kept["_kept_mark"])
    gone = saved(each.join(kept, same, "left_anti").select("_key", F.col("mark").alias("_mark")).distinct(), "near-gone")
    return drop_rows(docs, {"_key": docs[key], "_mark": text_mark(text)}, gone)
