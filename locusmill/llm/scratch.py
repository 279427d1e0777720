"""Batches of bounded size, what a worker remembers, and marks that tell rows of one key apart."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.sources.tables import BATCH_BYTES, BATCH_SETTING, Scratch, bounded_batches, discard, fresh_path, saved, shared_dir  # noqa: F401

Memo = TypeVar("Memo")
_memo: dict[object, object] = {}


def worker_memo(name: object, make: Callable[[], Memo]) -> Memo:
    """What this worker process remembers from task to task, under a name.

    Spark uses a worker again for the tasks of other operators. It holds the memo of one name at a
    time: the memo of another is freed before a new one is made.
    """
    if name not in _memo:
        _memo.clear()
        gc.collect()
        # What was freed goes back to the system, where the C library can do that.
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _memo[name] = make()
    return _memo[name]  # type: ignore[return-value]


def text_mark(text: str) -> Column:
    """A hash that tells rows of one key apart by their texts; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def in_arrow(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` in batches of some ``BATCH_BYTES``; every operator of this package goes through it."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)
