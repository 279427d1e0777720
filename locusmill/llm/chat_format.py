"""Chat formatting from an event log.

The log of a conversation is dealt to one partition and sorted by turn and sequence, then folded
as a stream: only the message that is being written is held, however long the conversation is.
``start`` opens a message, ``delta`` appends to the message its turn opened last, ``edit`` replaces
that message's text, and ``regenerate`` voids every earlier event of its own and of all later
turns and opens a message anew; what is void is left out before the fold. The folded messages are
rendered to ChatML-like turns:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside roles and texts are escaped by one more backslash in ``<|``, ``<\\|``, and
so on, which is taken off again when reading. The loss mask covers the escaped text of assistant
messages, as code-point offsets into the rendered part.

Defined cases: a null text, role or kind counts as empty, empty and ``start``; null turns and
sequences sort first; events that tie sort by kind, role and text; a delta or edit without a
message opens one; a null conversation id is a conversation of its own; repeated ``start`` rows
are turns of their own; an empty log gives no rows; texts of any length are taken whole; other
columns are never read. Parts that are missing or out of order are an error when reading back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PART_SCHEMA = "conv_id bigint, part bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>, last boolean"
READ_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
BATCH_CHARS = 4_000_000

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold_turn(events: Iterable[dict]) -> Iterator[tuple[str, str]]:
    """The messages of one turn from its sorted events, none of them void, one by one."""
    role, texts = "", None
    for e in events:
        if e["kind"] in ("start", "regenerate") or texts is None:
            if texts is not None:
                yield role, "".join(texts)
            role, texts = e["role"], [e["text"]]
        elif e["kind"] == "edit":
            texts = [e["text"]]
        else:
            texts.append(e["text"])
    if texts is not None:
        yield role, "".join(texts)


def render(role: str, text: str) -> tuple[str, list[dict]]:
    """A rendered turn and its loss mask."""
    head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
    loss = [{"start": len(head), "stop": len(head) + len(body)}] if role == LEARNED and body else []
    return f"{head}{body}{CLOSE}\n", loss


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _fold_and_render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_string()),
         ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("last", pa.bool_())]
    )
    out: list[dict] = []
    chars = 0
    for conv, log in groupby(_rows(batches), key=itemgetter("conv_id")):
        messages = (m for _, events in groupby(log, key=itemgetter("turn")) for m in fold_turn(events))
        held = next(messages, None)
        for part in count():
            if held is None:
                break
            formatted, loss = render(*held)
            held = next(messages, None)
            out.append({"conv_id": conv, "part": part, "formatted": formatted, "loss": loss, "last": held is None})
            chars += len(formatted)
            if chars > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, chars = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """One row per message, in the order of the conversation: conv_id, part, formatted, loss and last.

    ``events`` has conv_id, turn, seq, kind, role and text. Rows of a conversation stay together
    and in order; its whole text is its parts joined.
    """
    empty = lambda name, value="": F.coalesce(F.col(name), F.lit(value)).alias(name)
    log = events.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"),
        empty("kind", "start"), empty("role"), empty("text"),
    )
    # The window's shuffle by conversation is also the fold's; it spills where a conversation is long.
    so_far = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, W.currentRow)
    cut = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(so_far)
    log = log.withColumn("_cut", cut).where("_cut is null or seq >= _cut").drop("_cut")
    return in_arrow(log.sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text"), _fold_and_render, PART_SCHEMA)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a rendered text."""
    at = 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        yield _role_in(found[1]), unescape(found[2])
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


@dataclass
class _Reading:
    """What has been read of one conversation."""

    turns: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    n_turns: int = 0
    loss_chars: int = 0
    chars: int = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in READ_SCHEMA.split(", ")]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    for conv, parts in groupby(_rows(batches), key=itemgetter("conv_id")):
        read, ended = _Reading(), False
        for place, row in enumerate(parts):
            if ended or row["part"] != place:
                raise ValueError(f"conversation {conv}: part {row['part']} in place of part {place}; read with in_order=False")
            read.add(row["formatted"], row["loss"])
            ended = row["last"]
        if not ended:
            raise ValueError(f"conversation {conv}: its last part is missing; read with in_order=False")
        out.append((conv, read.n_turns, read.turns.hexdigest(), read.loss_chars, read.loss.hexdigest(), read.chars))
        if len(out) >= 10_000:
            yield batch()
            out = []
    yield batch()


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of every conversation as its rendered parts give them; an error where parts are missing or repeated.

    ``in_order`` says that the parts lie as ``format_conversations`` leaves them, partition by
    partition, which saves dealing and sorting them again.
    """
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return in_arrow(formatted, _read_back, READ_SCHEMA)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages as a log: each row starts its message."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("start").alias("kind"), "role", "text")


def as_streamed(conversations: DataFrame) -> DataFrame:
    """A table of finished messages as the log of how they may have come: in deltas, edited, and generated again.

    Of three messages of a conversation one is started whole, one comes in two deltas, and one is
    started otherwise and edited. A last message that is alone in its turn is first written
    otherwise and then generated again. The fold gives the messages back.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    at, first = F.row_number().over(order), F.lag(F.struct("turn")).over(order)
    alone_last = F.lead(F.lit(1)).over(order).isNull() & ~F.coalesce(first.eqNullSafe(F.struct("turn")), F.lit(False))
    rows = rows.withColumn("at", at.cast("bigint")).withColumn("again", alone_last)
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda i, kind, text: F.struct((F.col("at") * 4 + i).alias("seq"), F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    events = (
        F.when(F.col("again"), F.array(event(0, "start", "not "), event(1, "delta", "this"), event(2, "regenerate", head), event(3, "delta", tail)))
        .when(F.col("at") % 3 == 1, F.array(event(0, "start", F.col("text"))))
        .when(F.col("at") % 3 == 2, F.array(event(0, "start", ""), event(1, "delta", head), event(2, "delta", tail)))
        .otherwise(F.array(event(0, "start", "not "), event(1, "delta", "this"), event(2, "edit", F.col("text"))))
    )
    return rows.select("conv_id", "turn", "role", F.inline(events)).select("conv_id", "turn", "seq", "kind", "role", "text")
