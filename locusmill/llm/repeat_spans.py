"""Removal of byte strings that occur more than once in a corpus.

Not by merged Burrows-Wheeler transforms: interleaving shard transforms takes one pass over every
byte of the corpus for each byte of common prefix, 200 here, so by calculation it can't meet the
limits (see the README). What stays of it is the refinement of blocks of equal prefixes, of which only
those that are still undecided are looked at again, on a sample of the suffixes:

1. Every ``LENGTH``-byte window names an anchor, the leftmost least hash of its ``GRAM``-byte
   grams. Equal windows name the same anchor at the same offset. Consecutive windows that name
   one anchor are a run, a row of anchor, place and a hash of the run's bytes. Runs that a text
   has more than once, as periodic text does, are one row with the number of times; where they
   lie is settled at once, and neighbours among them are one row, too.
2. Runs of equal bytes (two independent 64-bit hashes) are a block. A block of two or more is
   repeated throughout, and one run stands for it from here on. An anchor with a single block is
   decided.
3. Where an anchor has several blocks, the bytes of one run of each are brought together and
   their windows compared; anchors of more than ``MOST_BLOCKS`` blocks compare through a shuffle.

Rows grow with the bytes divided by half a window, whatever repeats how often. Counts are aggregated
before the shuffle; keys that hold more than one row in ``HOT`` of all are at most ``HOT`` many and
are joined by broadcast, so that no task gets the rows of one. Texts of any length are taken in
segments of ``SEGMENT`` bytes that overlap by a window.

Defined cases: a null text is empty; texts shorter than a window keep all their bytes; matches
never cross documents; overlapping repeats inside one text count; rows that repeat a text (and a
key) are places of their own; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from locusmill.llm.scratch import in_arrow, saved

LENGTH = 200
GRAM = 32
SEGMENT = 1 << 20
#: A key with more than one in so many rows is settled where its rows are read.
HOT = 1000
#: Blocks of an anchor that one task compares at once; the windows of larger ones go through a shuffle.
MOST_BLOCKS = 4096
BATCH_BYTES = 4 << 20

_RANDOM = np.random.default_rng(20240713)
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


def _joined(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    x = left * _ODD[2 * step] + right
    x ^= x >> np.uint64(31)
    x *= _ODD[2 * step + 1]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of the given lengths: powers of two by doubling, others from their bits."""
    powers = {1: _BYTES[data]}
    size = 1
    while 2 * size <= max(lengths):
        half = powers[size]
        powers[2 * size] = _joined(half[:-size], half[size:], size.bit_length())
        size *= 2
    out = {}
    for length in lengths:
        bits = [1 << b for b in range(length.bit_length()) if length >> b & 1][::-1]
        total, at = powers[bits[0]], bits[0]
        for bit in bits[1:]:
            count = len(data) - at - bit + 1
            total = _joined(total[:count], powers[bit][at : at + count], 16 + bit.bit_length())
            at += bit
        out[length] = total
    return out


def _segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, max(len(data) - length + 1, 0), SEGMENT):
        yield start, data[start : start + SEGMENT + length - 1]


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run: its first window's start, how many windows, anchor hash, hash of its bytes."""
    parts = []
    for base, piece in _segments(data, length):
        hashes = gram_hashes(piece, {gram, length})
        grams, windows = hashes[gram], hashes[length]
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, length - gram + 1
        while width < span:
            by = min(width, span - width)
            least = np.minimum(least[:-by], least[by:])
            width += by
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(first, len(place)))
        block = _joined(windows[first], windows[first + count - 1], 28) + count.astype(np.uint64)
        parts.append((first + base, count, grams[place[first]], _joined(block, block, 29)))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def distinct_runs(at: np.ndarray, count: np.ndarray, anchor: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """at, count, times, anchor and block of rows for one text: each different run once, with its number of times, then spans
    of windows that the text itself repeats, with 0 times."""
    order = np.lexsort((block, anchor))
    new = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (block[order][1:] != block[order][:-1]))[: len(at)]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(at)))
    twice = np.zeros(len(at) + 2, bool)  # by place, with an end on either side
    twice[1:-1][order] = np.repeat(times > 1, times)
    start, stop = np.flatnonzero(twice[1:-1] & ~twice[:-2]), np.flatnonzero(twice[1:-1] & ~twice[2:])
    own, none = order[first], np.zeros(len(start), np.uint64)
    return (
        np.concatenate([at[own], at[start]]), np.concatenate([count[own], at[stop] + count[stop] - at[start]]), np.concatenate([times, np.zeros(len(start), np.int64)]),
        np.concatenate([anchor[own], none]), np.concatenate([block[own], none]),
    )


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _same (hash of the text, to tell rows of one key apart) and _text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), F.hash(body).alias("_same"), body.alias("_text"))


def _packed(texts: DataFrame) -> DataFrame:
    """The texts compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], ["_key", "_same", "_packed"])

    return in_arrow(texts, run, f"_key {texts.schema['_key'].dataType.simpleString()}, _same int, _packed binary")


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    key_type = texts.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [distinct_runs(*runs_of(np.frombuffer(t.encode(), np.uint8), length, gram)) for t in batch.column(2).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            at, count, times, anchor, block = (np.concatenate([f[i] for f in found]) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(times, pa.int32()),
                    pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)),
                ],
                ["_key", "_same", "at", "count", "times", "anchor", "block"],
            )

    return in_arrow(texts, run, f"_key {key_type}, _same int, at int, count int, times int, anchor bigint, block bigint")


def _with_texts(found: DataFrame, packed: DataFrame, how: str = "inner") -> DataFrame:
    """Packed texts beside what was found per key and text."""
    found = found.withColumnsRenamed({"_key": "_its_key", "_same": "_its_same"})
    same = packed["_key"].eqNullSafe(found["_its_key"]) & (packed["_same"] == found["_its_same"])
    return packed.join(found, same, how).drop("_its_key", "_its_same")


def _contexts(contested: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """anchor, wide, _key, _same, at, alone and the bytes of every contested run."""
    by_text = contested.groupBy("_key", "_same").agg(F.collect_list(F.struct("anchor", "wide", "at", "count", "alone")).alias("runs"))
    key_type = packed.schema["_key"].dataType.simpleString()
    names = ["anchor", "wide", "_key", "_same", "at", "alone", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                data = unpress.decompress(batch.column(2)[row].as_py())
                runs = batch.column(3)[row].as_py()
                cut = [data[r["at"] : r["at"] + r["count"] - 1 + length] for r in runs]
                owner = pa.array(np.full(len(runs), row))
                own = [batch.column(0).take(owner), batch.column(1).take(owner)]
                anchor, wide, at, alone = (pa.array([r[n] for r in runs], k) for n, k in
                                           (("anchor", pa.int64()), ("wide", pa.bool_()), ("at", pa.int32()), ("alone", pa.bool_())))
                yield pa.RecordBatch.from_arrays([anchor, wide, *own, at, alone, pa.array(cut, pa.binary())], names)

    rows = _with_texts(by_text, packed).select("_key", "_same", "_packed", "runs")
    return in_arrow(rows, run, f"anchor bigint, wide boolean, _key {key_type}, _same int, at int, alone boolean, bytes binary")


def _window_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of some contexts, with the context and the place each is of."""
    sizes = np.array([len(c) for c in contexts])
    first = np.append(0, np.cumsum(sizes)[:-1])
    hashes = gram_hashes(np.frombuffer(b"".join(contexts), np.uint8), {length})[length]
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
    return hashes[first[owner] + place], owner, place


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """_key, _same, at, count of repeated windows, from the contexts of whole anchors side by side."""
    kind = contexts.schema["_key"].dataType
    columns = ["anchor", "_key", "_same", "at", "alone", "bytes"]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        hashes, owner, place = _window_hashes([r[5] for r in rows], length)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(hashes), bool)
        twice[order] = np.append(same, False) | np.append(False, same)
        twice &= np.array([r[4] for r in rows])[owner]
        # Neighbouring repeated windows of one context make one row.
        starts = np.flatnonzero(twice & ~np.append(False, twice[:-1] & (owner[1:] == owner[:-1])))
        stops = np.flatnonzero(twice & ~np.append(twice[1:] & (owner[1:] == owner[:-1]), False))
        of = [rows[i] for i in owner[starts]]
        at = np.array([r[3] for r in of], np.int32) + place[starts].astype(np.int32) if of else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in of], to_arrow_type(kind)), pa.array([r[2] for r in of], pa.int32()), pa.array(at), pa.array((stops - starts + 1).astype(np.int32))],
            ["_key", "_same", "at", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []
        open_: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0][0] != row[0]:
                    whole += open_
                    open_ = []
                    if size > BATCH_BYTES:
                        yield compare(whole)
                        whole, size = [], 0
                open_.append(row)
                size += len(row[5])
        if whole or open_:
            yield compare(whole + open_)

    dealt = contexts.select(*columns).repartition("anchor").sortWithinPartitions("anchor")
    return in_arrow(dealt, run, f"_key {kind.simpleString()}, _same int, at int, count int")


def _shuffled(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many blocks, whose windows are compared through a shuffle, one row each."""
    kind = contexts.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, owner, place = _window_hashes(batch.column(4).to_pylist(), length)
            own = pa.array(owner)
            at = batch.column(2).take(own).to_numpy() + place.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(at, pa.int32()), batch.column(3).take(own), pa.array(hashes.view(np.int64)), batch.column(5).take(own)],
                ["_key", "_same", "at", "alone", "hash", "anchor"],
            )

    columns = contexts.select("_key", "_same", "at", "alone", "bytes", "anchor")
    windows = in_arrow(columns, run, f"_key {kind}, _same int, at int, alone boolean, hash bigint, anchor bigint")
    windows = saved(windows, "repeat-windows")
    twice = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "hash")
    return windows.where("alone").join(twice, ["anchor", "hash"], "left_semi").select("_key", "_same", "at", F.lit(1).alias("count"))


def _repeated(texts: DataFrame, packed: DataFrame, length: int, gram: int, most_blocks: int) -> DataFrame:
    """_key, _same, at, count: starts of repeated windows, ``count`` of them from ``at``."""
    all_runs = saved(_runs(texts, length, gram), "repeat-runs")
    runs, settled = all_runs.where("times > 0"), all_runs.where("times = 0").select("_key", "_same", "at", "count")
    most = runs.count() // HOT
    rows, windows = F.count(F.lit(1)).alias("rows"), F.sum("times").alias("n")
    twice = saved(runs.groupBy("anchor").agg(rows, windows).where("n > 1").select("anchor", "rows"), "repeat-anchors")
    runs = saved(_of_keys(runs, twice, ["anchor"], most), "repeat-shared")
    rep = F.min(F.struct("_key", "_same", "at", "count")).alias("rep")
    blocks = saved(runs.groupBy("anchor", "block").agg(rows, windows, rep), "repeat-blocks")
    whole = _of_keys(runs, blocks.where("n > 1").select("anchor", "block", "rows"), ["anchor", "block"], most)
    whole = whole.select("_key", "_same", "at", "count").unionByName(settled)
    several = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    contested = blocks.join(several, "anchor").select("anchor", (F.col("blocks") > most_blocks).alias("wide"), "rep.*", (F.col("n") == 1).alias("alone"))
    contexts = saved(_contexts(contested, packed, length), "repeat-contexts")
    single = _compared(contexts.where("not wide"), length).unionByName(_shuffled(contexts.where("wide"), length))
    return whole.unionByName(single)


def _of_keys(rows: DataFrame, keys: DataFrame, names: list[str], most: int) -> DataFrame:
    """Rows whose key is among ``keys`` (with the number of rows each has); keys of more than ``most`` rows by broadcast."""
    hot = saved(keys.where(F.col("rows") > most).select(*names), "repeat-hot")  # at most HOT keys have so many
    settled = rows.join(F.broadcast(hot), names, "left_semi")
    rest = rows.join(F.broadcast(hot), names, "left_anti").join(keys.where(F.col("rows") <= most).select(*names), names, "left_semi")
    return settled.unionByName(rest)


def merged_spans(at: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows: starts and exclusive stops."""
    order = np.argsort(at, kind="stable")
    start, stop = at[order], np.maximum.accumulate((at + count - 1 + length)[order])
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def _apply(found: DataFrame, packed: DataFrame, length: int, texts_too: bool) -> DataFrame:
    by_text = found.groupBy("_key", "_same").agg(F.collect_list(F.struct("at", "count")).alias("windows"))
    rows = _with_texts(by_text, packed, "left").select("_key", "_packed", "windows")
    names = ["_key", "n_bytes", "spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            sizes, spans, digests, kept = [], [], [], []
            for packed_text, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpress.decompress(packed_text)
                start = stop = np.empty(0, np.int64)
                if windows:
                    start, stop = merged_spans(*(np.array([w[n] for w in windows], np.int64) for n in ("at", "count")), length)
                left = b"".join(data[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(data)], strict=True))
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if texts_too else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(digests), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = packed.schema["_key"].dataType.simpleString()
    return in_arrow(rows, run, f"_key {kind}, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts_too: bool = True, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``key``, n_bytes, spans (removed bytes), kept_sha256 and kept (the remaining bytes; null unless asked for)."""
    texts = _texts(docs, key, text)
    packed = _packed(texts)
    found = _repeated(texts, packed, length, min(GRAM, length), most_blocks)
    return _apply(found, packed, length, texts_too).withColumnRenamed("_key", key)


def summary(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest for each document."""
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["start"])
    return removed.select(key, "n_bytes", total.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
