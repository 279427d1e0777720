"""Runs of repeated words by Kolpakov and Kucherov: all maximal periodic stretches of at least four periods.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST_WORDS``,
``EXPONENT`` * q) words that no neighbouring word extends with that period.

Each text is settled in one worker. Every word of a run stands in it ``EXPONENT`` times, so a text is
first cut at words that are rarer, again and again until nothing is cut; what is left is factorised:

1. a suffix automaton with the first end of each state gives the next factor, the longest prefix of
   the rest that occurred before (overlaps count), or one new word;
2. Main's algorithm finds, from common extensions to both sides of each factor's start, the runs
   that touch it. A run that ends in factor i starts at most |u(i-1)| + (|u(i-1)| + |u(i)|) / 3 words
   before that factor: were the factor before it to start a period after the run's start, it
   would have reached to the run's end, and the bound on the period follows from four periods;
3. the other runs lie strictly inside a factor and are copied, from left to right, from the factor's
   earlier occurrence.

Time is linear in the number of words, memory some 60 bytes a word of the longest piece.

Defined cases: a null text is empty and has no words, no runs and an empty rest. Rows with the same
key are judged apart; an empty table gives no rows; texts are taken whole, whatever their length;
other columns are never read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow

LEAST_WORDS = 6
EXPONENT = 4
SPACES = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]


def words(text: str) -> Column:
    """The words of a text, as an array."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES, -1), "")


def pieces(codes: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches in which each word stands at least ``exponent`` times; no run leaves one."""
    waiting = [(0, len(codes))]
    while waiting:
        start, end = waiting.pop()
        if end - start < least:
            continue
        counts = Counter(codes[start:end])
        rare = {c for c, n in counts.items() if n < exponent}
        if not rare:
            yield start, end
            continue
        at = start
        for i in range(start, end):
            if codes[i] in rare:
                if i - at >= least:
                    waiting.append((at, i))
                at = i + 1
        if end - at >= least:
            waiting.append((at, end))


class Automaton:
    """All substrings of a sequence, with where each ends first.

    A state with one way out keeps it in two arrays; only states with more have a table.
    """

    def __init__(self, codes: Sequence[int]) -> None:
        self.letter, self.to = array("q", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        last = 0
        for at, code in enumerate(codes):
            last = self._extend(last, code, at)

    def step(self, state: int, code: int) -> int:
        if self.letter[state] == code:
            return self.to[state]
        ways = self.more.get(state)
        return -1 if ways is None else ways.get(code, -1)

    def _set(self, state: int, code: int, target: int) -> None:
        held = self.letter[state]
        if held == code:
            self.to[state] = target
        elif held == -1:
            self.letter[state], self.to[state] = code, target
        else:
            self.more.setdefault(state, {})[code] = target

    def _new(self, size: int, first: int) -> int:
        self.letter.append(-1)
        self.to.append(-1)
        self.link.append(0)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _extend(self, last: int, code: int, at: int) -> int:
        link, size = self.link, self.size
        new = self._new(size[last] + 1, at)
        p = last
        while p != -1 and self.step(p, code) == -1:
            self._set(p, code, new)
            p = link[p]
        if p == -1:
            return new
        q = self.step(p, code)
        if size[q] == size[p] + 1:
            link[new] = q
            return new
        twin = self._new(size[p] + 1, self.first[q])
        self.letter[twin], self.to[twin] = self.letter[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        link[twin] = link[q]
        link[q] = link[new] = twin
        while p != -1 and self.step(p, code) == q:
            self._set(p, code, twin)
            p = link[p]
        return new


def factors(codes: Sequence[int]) -> list[tuple[int, int, int]]:
    """Start, end and earlier start (-1 for a new word) of each factor."""
    known = Automaton(codes)
    step, first = known.step, known.first
    out, start, n = [], 0, len(codes)
    while start < n:
        state, end = 0, start
        while end < n:
            after = step(state, codes[end])
            if after == -1 or first[after] >= end:
                break
            state, end = after, end + 1
        if end == start:
            out.append((start, start + 1, -1))
        else:
            out.append((start, end, first[state] - (end - start) + 1))
        start = out[-1][1]
    return out


def prefix_lengths(s: Sequence[int], upto: int) -> list[int]:
    """For each place of ``s`` below ``upto`` how many entries from it on equal the start of ``s``."""
    n = len(s)
    z = [0] * min(upto, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(head: list[int], tail: list[int], upto: int) -> list[int]:
    """For each place of ``tail`` below ``upto`` how many entries from it on equal the start of ``head``."""
    return prefix_lengths([*head, -1, *tail], len(head) + 1 + upto)[len(head) + 1 :]


def touching(codes: list[int], before: int, at: int, after: int, least: int, exponent: int) -> Iterator[Run]:
    """Runs that touch place ``at`` and end in the factor that starts there (up to ``after``), or end at it and start in the factor before."""
    old, new = at - before, after - at
    most = max((old + new) // (exponent - 1), old // exponent)
    if most == 0:
        return
    left = codes[max(0, at - old - most - 1) : at][::-1]
    right = codes[at : after + 1]
    ahead = left[::-1] + right
    # With a period to the right of the place: right against itself, and left against what ends a period further on.
    p_right = min(most, len(right))
    right_right = [*prefix_lengths(right, p_right + 1), 0]
    further = right[:p_right][::-1] + left
    right_left = [*_across(left, further, p_right + 1), 0]
    # With a period to the left of it: left against itself, and right against what starts a period before.
    p_left = min(most, len(left))
    left_left = [*prefix_lengths(left, p_left + 1), 0]
    left_right = _across(right, ahead[len(left) - p_left :], p_left)
    for p in range(1, most + 1):
        need = max(exponent * p, least)
        found = []
        if p <= p_right:
            found.append((at - right_left[p_right - p], at + p + right_right[p]))
        if p <= p_left:
            found.append((at - p - left_left[p], at + left_right[p_left - p]))
        for start, end in found:
            if end - start >= need and start <= at <= end <= after and (end > at or start > before):
                yield start, end, p


def runs_of(codes: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[Run]:
    """Start, end and smallest period of every run, by start, then period."""
    parts = factors(codes)
    ends: dict[tuple[int, int], int] = {}
    before = 0
    for start, end, _ in [*parts, (len(codes), len(codes), -1)]:
        if start:
            for s, e, p in touching(codes, before, start, end, least, exponent):
                ends[s, e] = min(p, ends.get((s, e), p))
        before = start
    by_start: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (s, e), p in ends.items():
        by_start[s].append((e, p))
    if by_start:
        starts = sorted(by_start)
        for start, end, source in parts:
            shift, stop = start - source, source + end - start
            if source < 0:
                continue
            # Sources may reach into their own copies, so places are taken as they grow.
            i = bisect_right(starts, source)
            while i < len(starts) and starts[i] < stop:
                s = starts[i]
                inner = [(e, p) for e, p in by_start[s] if e < stop]
                if inner:
                    if s + shift not in by_start:
                        starts.insert(bisect_left(starts, s + shift), s + shift)
                    held = {e for e, _ in by_start[s + shift]}
                    by_start[s + shift] += [(e + shift, p) for e, p in inner if e + shift not in held]
                i += 1
    return sorted(((s, e, p) for s, found in by_start.items() for e, p in found), key=lambda r: (r[0], r[2]))


def text_runs(tokens: list[bytes] | list[str], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[Run]:
    """Start, end and smallest period of every run of words."""
    numbers: dict[object, int] = {}
    codes = [numbers.setdefault(t, len(numbers)) for t in tokens]
    return sorted(((s + at, e + at, p) for at, end in pieces(codes, least, exponent) for s, e, p in runs_of(codes[at:end], least, exponent)), key=lambda r: (r[0], r[2]))


def collapsed(tokens: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, upto = [], 0
    for start, end in sorted((s + p, e) for s, e, p in runs):
        kept += tokens[upto:start] if start > upto else []
        upto = max(upto, end)
    return kept + tokens[upto:]


FOUND = "_key {key}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: ``key``, runs (by start, then period; in words) and collapsed, the words left after one period of each run."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for data in batch.column("_text"):
                # bytes.split() cuts at exactly 0x20 and 0x09-0x0D.
                tokens = data.as_py().split()
                runs = text_runs(tokens, least, exponent)
                found.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs])
                left.append(b" ".join(collapsed(tokens, runs)).decode())
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, kind), pa.array(left, pa.string())], ["_key", "runs", "collapsed"])

    return in_arrow(rows, find, FOUND.format(key=docs.schema[key].dataType.simpleString())).withColumnRenamed("_key", key)


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``; one row in ten, by the crc32 of its key, repeats a stretch of its words up to its end.

    A null key counts as an empty string.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_h"), words(text).alias("_words"))
    n, g = F.size("_words").cast("bigint"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))))
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.element_at("_words", (at(i) + 1).cast("int")))
    put = F.when((F.col("_h") % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("_text"))
    return rows.select(F.col("_key").alias(key), put.alias(text))


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest run, the number of runs, and digests of all runs and of what is left, for each document."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_longest", longest).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), F.col("_longest.start").alias("start"), (-F.col("_longest.short")).alias("length"),
        F.col("_longest.period").alias("period"), F.expr("(-1000 * _longest.short) div _longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
