"""A blocked Bloom filter that is built by all tasks and broadcast: what was met once, and what was met twice.

Each task reduces 64-bit hashes to places, two for each in one block, and tells places met once from
places met twice. The pieces of a block are folded as a stream, each block in one task: a place is
in the once-seen filter if any piece holds it, in the twice-seen filter if a piece holds it twice or
two pieces hold it once. A hash that was met, or met twice, is always in its filter; others seldom.

A filter has ``BITS_PER_KEY`` bits for each hash, counted beforehand, up to ``MOST_BITS`` (128 MB), which bounds the
broadcast; beyond some 10^8 hashes it only holds more in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow, saved

BLOCK_BITS = 1 << 15
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
BITS_PER_KEY = 8
#: Places that a task holds before it folds them into pieces.
HELD = 1 << 22


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places for each hash, in the block that its high bits name."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(34)) % np.uint64(bits // BLOCK_BITS) * np.uint64(BLOCK_BITS)
    low = np.uint64(BLOCK_BITS - 1)
    return np.concatenate([block + (h & low), block + ((h >> np.uint64(15)) & low)])


def _block_and_bits(h: str, bits: int) -> tuple[Column, list[Column]]:
    block = F.shiftrightunsigned(h, 34) % F.lit(bits // BLOCK_BITS)
    return block, [F.col(h).bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(h, 15).bitwiseAND(BLOCK_BITS - 1)]


PIECES = pa.schema([("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _pieces(places: np.ndarray) -> pa.RecordBatch:
    """One row for each block that holds a place: its places, and those met more than once."""
    found, counts = np.unique(places, return_counts=True)
    block, inner = found // BLOCK_BITS, (found % BLOCK_BITS).astype("<u2")
    starts = np.flatnonzero(np.diff(block, prepend=np.uint64(2**63)))
    ends = [*starts[1:], len(found)]
    again = counts > 1
    once = [inner[a:b].tobytes() for a, b in zip(starts, ends)]
    twice = [inner[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int64)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], schema=PIECES)


def filters(hashes: DataFrame, bits: int, held: int = HELD) -> DataFrame:
    """block, once and twice (arrays of 64-bit words) of the filter of a one-column table of 64-bit hashes."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            waiting.append(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            size += len(waiting[-1])
            if size >= held:
                yield _pieces(np.concatenate(waiting))
                waiting, size = [], 0
        if size:
            yield _pieces(np.concatenate(waiting))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(column.to_pylist() for column in batch.columns)):
                if block not in known:
                    known[block] = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                seen, again = known[block]
                new = np.frombuffer(once, "<u2")
                again[new[seen[new]]] = True
                again[np.frombuffer(twice, "<u2")] = True
                seen[new] = True
        blocks = sorted(known)
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            words = [[np.packbits(known[b][i], bitorder="little").view("<i8").tolist() for b in some] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(w, pa.list_(pa.int64())) for w in words)], ["block", "once", "twice"])

    pieces = in_arrow(hashes, reduce, "block bigint, once binary, twice binary")
    return in_arrow(pieces.repartition("block"), fold, "block bigint, once array<bigint>, twice array<bigint>")


def maybe_in(df: DataFrame, h: str, known: DataFrame, words: str, bits: int, how: str = "inner") -> DataFrame:
    """``df`` with a column _maybe: whether the hash ``h`` may be in the broadcast filter. At most ``bits`` / 8 bytes are broadcast."""
    block, places = _block_and_bits(h, bits)
    blocks = known.select(F.col("block").alias("_block"), F.col(words).alias("_words"))
    joined = df.withColumn("_at", block).join(F.broadcast(blocks), F.col("_at") == F.col("_block"), how)
    held = [F.getbit(F.element_at("_words", (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in places]
    return joined.withColumn("_maybe", F.coalesce(held[0] & held[1], F.lit(False))).drop("_at", "_block", "_words")


def bits_for(keys: int) -> int:
    """A power of two with room for so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys).bit_length()))


def once_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """block and bitmap of the once-seen filter of a column _hash, by Spark's own bitmaps: no Python."""
    block, places = _block_and_bits("_hash", bits)
    each = hashes.select(block.alias("block"), F.explode(F.array(*places)).alias("_place"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("_place").alias("bitmap"))


def maybe_among(df: DataFrame, marks: list[str], known: DataFrame) -> DataFrame:
    """``df`` with a column _maybe: whether a row of ``known`` may have its marks. False is sure. DataFrame functions only."""
    bits = bits_for(known.count())
    held = saved(once_filter(known.select(F.xxhash64(*marks).alias("_hash")), bits), "bloom").withColumnRenamed("block", "_block")
    block, places = _block_and_bits("_hash", bits)
    rows = df.withColumn("_hash", F.xxhash64(*marks)).withColumn("_at", block)
    rows = rows.join(F.broadcast(held), F.col("_at") == F.col("_block"), "left")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1

    return rows.withColumn("_maybe", F.coalesce(is_set(places[0]) & is_set(places[1]), F.lit(False))).drop("_hash", "_at", "_block", "bitmap")


def drop_rows(docs: DataFrame, marks: dict[str, Column], gone: DataFrame) -> DataFrame:
    """The rows whose marks, columns made of theirs, are not in ``gone``, a table of distinct marks without nulls but in the first.

    Only rows that may go are shuffled, the others stay where they are read; columns keep their names and order. DataFrame functions only.
    """
    first, *others = marks
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in marks.items()))
    rows = maybe_among(rows, list(marks), gone)
    going = gone.withColumnsRenamed({n: f"_gone{n}" for n in marks})
    same = rows[first].eqNullSafe(going[f"_gone{first}"])
    for name in others:
        same &= rows[name] == going[f"_gone{name}"]
    stays = rows.where(~F.col("_maybe")).unionByName(rows.where("_maybe").join(going, same, "left_anti"))
    return stays.select("_row.*")
