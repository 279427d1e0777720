"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions of low rank in time linear in the number of features. Features of a whole text are
its distinct words, hashed, weighted by their damped share, and statistics of its bytes, lines
and words. The metadata of a document (id, language, source, labels) is never an input.

The model is fitted on at most ``MOST_LABELLED`` labelled rows, those with the smallest hash of
their id, whose crc32 isn't held out, and one text of each. That sample's features are computed on
the executors and brought to the driver (bounded), and the weights (fixed size) are broadcast for
scoring. Words are remembered up to ``WORDS_REMEMBERED``, which never changes a score.

Defined cases: a null text counts as empty and is scored; ids with several labels count with the
largest; null labels teach nothing; without both classes the score is the share of label 1 with
one more of each class; repeated rows score alike; an empty table gives no rows; extra columns
are never read. A null id is never held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow, text_mark, worker_memo

MOST_LABELLED = 5000
BUCKETS = 1 << 13
RANK = 4
EPOCHS = 30
BATCH = 64
STEP = 0.05
PENALTY = 1e-4
SEED = 7
THRESHOLD = 0.5
WORDS_REMEMBERED = 100_000

_STATS = 24
DIMENSIONS = BUCKETS + _STATS
_CLASSES = np.zeros(256, np.int64)
for _name, _code in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r", 4), (b"\n", 5),
                     (b".,;:'\"-()", 6), (b"!?", 7), (b"#$%&*@+=^~_<>/\\", 8), (b"|{}[]`", 9)):
    _CLASSES[list(_name)] = _code
_CLASSES[128:] = 10


class Features:
    """Indexes and values of texts; words' buckets are remembered up to a bound."""

    def __init__(self) -> None:
        self._buckets: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        found = self._buckets.get(word)
        if found is None:
            if len(self._buckets) >= WORDS_REMEMBERED:
                self._buckets.clear()
            found = self._buckets[word] = zlib.crc32(word.encode()) % BUCKETS
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        share: Counter[int] = Counter()
        for word, times in counts.items():
            share[self._bucket(word)] += times
        values = np.log1p(np.fromiter(share.values(), np.float32, len(share)))
        values /= max(float(np.linalg.norm(values)), 1.0)
        stats = self._stats(text, words, counts)
        index = np.concatenate([np.fromiter(share, np.int32, len(share)), np.arange(BUCKETS, DIMENSIONS, dtype=np.int32)])
        return index, np.concatenate([values, stats]).astype(np.float32)

    @staticmethod
    def _stats(text: str, words: list[str], counts: Counter[str]) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        kinds = np.bincount(_CLASSES[data], minlength=11).astype(np.float32) / max(len(data), 1)
        n = max(len(words), 1)
        lines = text.split("\n")
        lengths = sum(map(len, counts))
        plain = sum(k for w, k in counts.items() if w.isalpha())
        more = [
            np.log1p(len(words)) / 10, len(counts) / n, max(counts.values(), default=0) / n, lengths / max(len(counts), 1) / 20,
            plain / n, sum(k for w, k in counts.items() if w.isupper() and len(w) > 1) / n, sum(k for w, k in counts.items() if w[-1] in "#$%&*!|") / n,
            len(set(lines)) / len(lines), len(lines) / n, sum(k for w, k in counts.items() if len(w) <= 3) / n,
            float(not words), sum(k for w, k in counts.items() if w[-1] in ".!?") / n, np.log1p(len(text) / len(lines)) / 10,
        ]
        return np.concatenate([np.sqrt(kinds), np.array(more, np.float32)])


@dataclass
class Machine:
    """Weights of the factorisation machine; dense statistics are standardised before use."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standardised(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        out[-_STATS:] = np.clip((values[-_STATS:] - self.mean) / self.scale, -4, 4) / 4
        return out

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        x = self.standardised(index, values)
        v = self.factors[index]
        total = x @ v
        margin = self.bias + float(x @ self.linear[index]) + 0.5 * float(total @ total - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Adagrad on the logistic loss, over the rows in the order given and shuffled by a fixed seed."""
    positive, n = int(labels.sum()), len(labels)
    prior = float(np.log((positive + 1) / (n - positive + 1)))
    machine = Machine(prior, np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, RANK), np.float32), np.zeros(_STATS, np.float32), np.ones(_STATS, np.float32))
    if positive in (0, n):
        return machine
    dense = np.array([values[-_STATS:] for _, values in rows])
    machine.mean, machine.scale = dense.mean(0), dense.std(0) + 1e-3
    random = np.random.default_rng(SEED)
    machine.factors[:] = random.normal(0, 0.02, machine.factors.shape)
    ready = [(index, machine.standardised(index, values)) for index, values in rows]
    squares = [1e-6, np.full(DIMENSIONS, 1e-6, np.float32), np.full((DIMENSIONS, RANK), 1e-6, np.float32)]
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for start in range(0, n, BATCH):
            chosen = order[start : start + BATCH]
            index = np.concatenate([ready[i][0] for i in chosen])
            x = np.concatenate([ready[i][1] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(ready[i][0]) for i in chosen])[:-1]])
            size = np.diff(np.append(first, len(index)))
            v = machine.factors[index]
            xv = x[:, None] * v
            total = np.add.reduceat(xv, first)
            margin = machine.bias + np.add.reduceat(x * machine.linear[index], first)
            margin = margin + 0.5 * ((total**2).sum(1) - np.add.reduceat((xv**2).sum(1), first))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, size).astype(np.float32)
            where, back = np.unique(index, return_inverse=True)
            linear = np.bincount(back, each * x, len(where)).astype(np.float32) + PENALTY * machine.linear[where]
            toward = each[:, None] * x[:, None] * (np.repeat(total, size, 0) - xv)
            factors = np.stack([np.bincount(back, toward[:, f], len(where)) for f in range(RANK)], 1).astype(np.float32)
            factors += PENALTY * machine.factors[where]
            squares[0] += float(error.sum()) ** 2
            squares[1][where] += linear**2
            squares[2][where] += factors**2
            machine.bias -= STEP * float(error.sum()) / squares[0] ** 0.5
            machine.linear[where] -= STEP * linear / np.sqrt(squares[1][where])
            machine.factors[where] -= STEP * factors / np.sqrt(squares[2][where])
    return machine


def held_out(key: str) -> Column:
    """Whether a row is kept back from the fit."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = worker_memo("features", Features)
    for batch in batches:
        made = [features.of(t) for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), batch.column(2), *(pa.array([m[i].tobytes() for m in made], pa.binary()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "label", "index", "values"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Machine:
    """A machine from at most ``most`` labelled rows that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # at most ``most`` rows are broadcast
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("key") == F.col("_id"))
    # One row for each sampled id, however often it is repeated: that with the least mark of its text.
    rows = rows.groupBy("key").agg(F.min(F.struct(text_mark("text").alias("mark"), "text", "label")).alias("one")).select("key", "one.text", "one.label")
    kind = rows.schema["key"].dataType.simpleString()
    made = in_arrow(rows, _features, f"key {kind}, label int, index binary, values binary").toArrow().sort_by("key")
    index = [np.frombuffer(b, np.int32) for b in made.column("index").to_pylist()]
    values = [np.frombuffer(b, np.float32) for b in made.column("values").to_pylist()]
    return fit(list(zip(index, values, strict=True)), made.column("label").to_numpy().astype(np.float32))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score, predicted: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = worker_memo("features", Features), shared.value
        for batch in batches:
            scores = [model.score(*features.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = in_arrow(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The documents that the machine doesn't reject; columns stay as they are. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = worker_memo("features", Features), shared.value
        for batch in batches:
            good = [model.score(*features.of(t or "")) >= THRESHOLD for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
