"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A text is cut by the tokenizer's pattern, and each cut is encoded on its own. Merges are compiled
into a transducer over bytes: a thread stands for "the encoding so far ends in token p, and the
bytes since then spell this node of the token trie". Reading a byte moves every thread; of the
tokens that end there, exactly one may follow its thread's last token (two tokens may be
neighbours if merging their joined bytes gives them back), and it starts a new thread. The set of
live threads, without positions, is a state; states and their moves are made when first met and
kept, as numbers. Every ``LOOK_BACK`` bytes the tokens that the traces of all live threads share are emitted; traces
from threads of one state, which began within the longest token, meet again soon, so that bounds the
lookahead, whatever the length of a cut. Cuts already met are taken from a bounded memo first.

Decoding joins token bytes and hands out text as soon as characters are whole, through an
incremental UTF-8 state machine that carries at most three bytes from one piece to the next.

Defined cases: a null text counts as empty and has no tokens; texts of any length are processed
whole; no special tokens are recognised; repeated rows and extra columns (never read) change
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow, worker_memo

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what a worker remembers; beyond them it forgets everything and starts over.
MEMO_CUTS = 200_000
MEMO_MOVES = 500_000
MEMO_PAIRS = 30_000
NODE_BITS = 24
NODE = (1 << NODE_BITS) - 1
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1
#: After so many bytes what is certain is emitted; a shorter cut is traced at once.
LOOK_BACK = 256
#: Tokens that the decoding stream is fed at once.
DECODED = 1000
BATCH_ROWS = 256


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text whose characters are whole."""

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end belong to a character that isn't whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._held + data
        tail = self.open_tail(data)
        self._held = data[len(data) - tail :]
        return data[: len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        held, self._held = self._held, b""
        return held.decode("utf-8", "replace")


class BytePairTransducer:
    """Encodes one cut of a text at a time.

    A thread is one number: its last token plus one (0 at the start), then its trie node.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.names: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self._children: dict[int, int] = {}
        self._lengths = [0] * len(self.names)
        self._token: list[int] = [-1]
        self._depths = array("H", [0])
        for name, token in ranks.items():
            self.names[token], self._lengths[token] = name, len(name)
            node = 0
            for depth, byte in enumerate(name, 1):
                move = node << 8 | byte
                node = self._children.get(move, 0)
                if not node:
                    node = self._children[move] = len(self._token)
                    self._token.append(-1)
                    self._depths.append(depth)
            self._token[node] = token
        # A thread ends at a node from which no longer token can be spelt; the last bit says which do not.
        inner = {move >> 8 for move in self._children}
        self._children = {move: node << 1 | (node in inner) for move, node in self._children.items()}
        self._splits: list[tuple[int, int] | tuple[()] | None] = [()] * len(self.names)
        self._pairs: dict[int, bool] = {}
        self._cuts: dict[str, list[int]] = {}
        self._old_cuts: dict[str, list[int]] = {}
        self._forget_states()

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """By the definition: join the neighbours of lowest rank, leftmost first, until ``stop`` parts or no pair is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.names)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; itself twice for a byte; None if no merge makes it."""
        found = self._splits[token]
        if found == ():
            name, parts = self.names[token], [token]
            if len(name) > 1:
                parts = self.merge(name, stop=2)
                whole = self.ranks.get(b"".join(self.names[p] for p in parts)) if len(parts) == 2 else None
                parts = parts if whole == token else []
            found = self._splits[token] = (parts[0], parts[-1]) if parts else None
        return found

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may come right after ``last`` (-1: at the start).

        Time runs with the ranks. Going back from the two finished tokens, the later one is undone
        first; at each step the tokens at the seam must not have merged before they were used up.
        """
        if last < 0 or self._split(token) is None:
            return self._split(token) is not None
        pair = last << 32 | token
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._seam_holds(last, token)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        never = len(self.names)
        left_used, right_used = never, never
        while True:
            joined = self.ranks.get(self.names[left] + self.names[right])
            if joined is not None and joined < left_used and joined <= right_used:
                return False
            left_whole, right_whole = self._lengths[left] == 1, self._lengths[right] == 1
            if left_whole and right_whole:
                return True
            if right_whole or not left_whole and left > right:
                left_used, left = left, self._split(left)[1]
            else:
                right_used, right = right, self._split(right)[0]

    def _forget_states(self) -> None:
        """Starts over, with the state of the start as 0."""
        self._states: dict[bytes, int] = {}
        #: Threads of each state, eight bytes each.
        self._threads: list[bytes] = []
        #: By state and byte: the next state, and the token that ends there, plus one.
        self._moves: dict[int, int] = {}
        self._state(bytes(8))

    def _state(self, threads: bytes) -> int:
        found = self._states.get(threads)
        if found is None:
            found = self._states[threads] = len(self._threads)
            self._threads.append(threads)
        return found

    def _move(self, state: int, byte: int) -> int:
        """Makes the move of a state at a byte, and remembers it."""
        threads, ended = array("Q"), -1
        child_of, token_at = self._children.get, self._token
        for thread in memoryview(self._threads[state]).cast("Q"):
            child = child_of((thread & NODE) << 8 | byte)
            if child is not None:
                if child & 1:
                    threads.append(thread & ~NODE | child >> 1)
                if ended < 0:
                    token = token_at[child >> 1]
                    if token >= 0 and self.follows((thread >> NODE_BITS) - 1, token):
                        ended = token
        threads.append(ended + 1 << NODE_BITS)
        move = self._moves[state << 8 | byte] = self._state(threads.tobytes()) << TOKEN_BITS | ended + 1
        return move

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes, each as soon as no byte to come can change it."""
        state, ends, look = 0, [], LOOK_BACK
        for byte in data:
            move = self._moves.get(state << 8 | byte) or self._move(state, byte)
            state = move >> TOKEN_BITS
            ends.append((move & TOKEN) - 1)
            if len(ends) >= look:
                threads = self._threads[state]
                certain = self._shared(ends, threads)
                yield from self._between(ends[:certain])
                del ends[:certain]
                look = len(ends) + LOOK_BACK
                if len(self._moves) >= MEMO_MOVES:
                    self._forget_states()
                    state = self._state(threads)
        yield from self._between(ends)

    def _shared(self, ends: list[int], threads: bytes) -> int:
        """The last place that the traces of all threads have in common: from the places where they began, the furthest goes back token by token."""
        places = {len(ends) - self._depths[thread & NODE] for thread in memoryview(threads).cast("Q")}
        while len(places) > 1:
            places.remove(last := max(places))
            places.add(last - self._lengths[ends[last - 1]])
        return places.pop()

    def _at_once(self, data: bytes) -> list[int]:
        """``stream`` for a short cut."""
        state, ends, known = 0, [], self._moves.get
        for byte in data:
            move = known(state << 8 | byte) or self._move(state, byte)
            state = move >> TOKEN_BITS
            ends.append((move & TOKEN) - 1)
        return self._between(ends)

    def _between(self, ends: list[int]) -> list[int]:
        """Tokens from the one that ends at each byte, traced from the last."""
        tokens, at = [], len(ends)
        while at:
            tokens.append(token := ends[at - 1])
            at -= self._lengths[token]
        tokens.reverse()
        return tokens

    def encode_cut(self, cut: str) -> list[int]:
        """Tokens of one cut; a cut that is itself a token is that token.

        The memo has two generations: when the younger is full it becomes the older, and what is asked for again moves on.
        """
        known = self._cuts.get(cut)
        if known is not None:
            return known
        known = self._old_cuts.get(cut)
        data = cut.encode() if known is None else b""
        if known is None:
            if data in self.ranks:
                known = [self.ranks[data]]
            else:
                if len(self._moves) >= MEMO_MOVES:
                    self._forget_states()
                known = self._at_once(data) if len(data) <= LOOK_BACK else list(self.stream(data))
        if len(data) <= 64:
            if len(self._cuts) >= MEMO_CUTS // 2:
                self._old_cuts, self._cuts = self._cuts, {}
            self._cuts[cut] = known
        return known


@cache
def _unassigned() -> str:
    """All characters that Python's own tables leave open."""
    codes = (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return "".join(c for c in codes if unicodedata.category(c) == "Cn")


def newer_characters(kind: str) -> str:
    """Ranges of characters that ``regex`` puts in class ``kind`` and the tokenizer library's older tables don't.

    Both agree on all characters that are assigned in Python's own tables, so only the rest are asked for.
    """
    single = {bytes([i]): i for i in range(256)}
    theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
    runs: list[list[int]] = []
    for code in (ord(c) for c in regex.findall(kind, _unassigned()) if not theirs.encode_ordinary(c)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in runs)


class ByteBpe:
    """A vocabulary of ranks with the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = BytePairTransducer(ranks)
        self._cut = regex.compile(pattern).findall
        # Texts with characters that only newer tables call letters or numbers take the strict pattern.
        letters, numbers = (newer_characters(kind) for kind in (r"\p{L}", r"\p{N}"))
        self._newer = re.compile(f"[{letters}{numbers}]").search
        self._least_newer = min(int(code, 16) for code in re.findall(r"\\U(\w{8})", letters + numbers))
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{letters}{numbers}]|[^\s\p{{L}}\p{{N}}])")
        strict = strict.replace(r"?\p{L}+", rf"?(?:(?![{letters}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{numbers}])\p{{N}})+")
        self._cut_strictly = regex.compile(strict).findall

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "ByteBpe":
        return cls(ranks_of(path), pattern)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, encode = self.transducer._cuts.get, self.transducer.encode_cut
        for cut in self._cuts_of(text):
            out += known(cut) or encode(cut)
        return out

    def _cuts_of(self, text: str) -> list[str]:
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            if codes.max() >= self._least_newer and self._newer(text):
                return self._cut_strictly(text)
        return self._cut(text)

    def decode_stream(self, tokens: Iterable[int]) -> Iterator[str]:
        """Text, handed out token by token as characters become whole."""
        stream = Utf8Stream()
        for token in tokens:
            if text := stream.feed(self.transducer.names[token]):
                yield text
        if text := stream.close():
            yield text


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(name): int(rank) for name, rank in map(bytes.split, filter(bytes.strip, lines))}


def decode_text(names: list[bytes], ids: bytes) -> str:
    """The text of some ids, by a stream of ``DECODED`` tokens at a time."""
    tokens = np.frombuffer(ids, "<u4").tolist()
    stream, name = Utf8Stream(), names.__getitem__
    pieces = [stream.feed(b"".join(map(name, tokens[i : i + DECODED]))) for i in range(0, len(tokens), DECODED)]
    return "".join(pieces) + stream.close()


def _worker_bpe(vocabulary: str) -> ByteBpe:
    """One vocabulary for a worker process, found where the executor has it installed."""
    import public_tokenizers

    return worker_memo(("bpe", vocabulary), lambda: ByteBpe.from_file(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN))


@cache
def _worker_names(vocabulary: str) -> list[bytes]:
    """The tokens alone, by id: some 5 MB, all that decoding takes."""
    import public_tokenizers

    ranks = ranks_of(public_tokenizers.path(vocabulary))
    names = [b""] * (max(ranks.values()) + 1)
    for name, token in ranks.items():
        names[token] = name
    return names


@contextmanager
def _no_collection() -> Iterator[None]:
    """Without passes of the garbage collector over the memos, which free what they drop themselves."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ids (little-endian unsigned 32-bit integers as binary), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary)
        with _no_collection():
            for batch in _small(batches):
                ids = [np.array(bpe.encode(t), "<u4").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_arrow(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ids and text, decoded as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _worker_names(vocabulary)
        for batch in _small(batches):
            texts = [decode_text(names, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [key, "ids", "text"])

    rows = encoded.select(key, "ids")
    return in_arrow(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``decode(encode(docs))``, by one worker for each task instead of a chain of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary)
        with _no_collection():
            for batch in _small(batches):
                ids = [np.array(bpe.encode(t), "<u4").tobytes() for t in batch.column(1).to_pylist()]
                texts = [decode_text(bpe.transducer.names, i) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [key, "ids", "text"])

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_arrow(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary, text string")


def summary(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of ids and of the decoded text."""
    return decoded.select(
        key, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
