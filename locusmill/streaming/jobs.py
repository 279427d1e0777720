"""Import jobs and tombstones as state by key (STR-07, STR-12, STR-16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from locusmill.streaming.in_order import in_order

ANSWER = StructType([StructField("event_id", LongType()), StructField("at", LongType()), StructField("answer", StringType())])
SECOND = 1_000_000
#: What a start hears while a job is held.
HEARD = {"fetching": "joined", "saved": "done", "failed": "refused"}


@dataclass
class ImportJob:
    """A job of a key: fetching from its first start until it is saved or fails.

    A start while it fetches joins it; one after it was saved is done already, until the result is forgotten; one too soon after a
    failure is refused. A job that fetches for too long fails then. Times are in seconds.
    """

    limit: int
    back_off: int
    keep: int

    def __post_init__(self):
        self._lasts = {"fetching": SECOND * self.limit, "failed": SECOND * self.back_off, "saved": SECOND * self.keep}

    def take(self, held, at, event, kind):
        status = held[0] if held else "idle"
        if kind == "poll":
            return held, [(event, at, status)]
        if kind == "start":
            return (held, [(event, at, HEARD[status])]) if held else (("fetching", at), [(event, at, "started")])
        if kind in ("saved", "missing"):
            if status != "fetching":
                return held, [(event, at, "ignored")]
            return (("saved", at), [(event, at, "saved")]) if kind == "saved" else (("failed", at), [(event, at, "no-pdf")])
        return held, []

    def due(self, held):
        return held[1] + self._lasts[held[0]]

    def lapse(self, held):
        at = self.due(held)
        if held[0] == "fetching":
            return ("failed", at), [(None, at, "timed-out")]
        return None, [(None, at, "forgotten")] if held[0] == "saved" else []


def import_jobs(events: DataFrame, key: str, limit: int, back_off: int, keep: int, delay: str) -> DataFrame:
    """``key``, event_id, at (microseconds) and answer: one for each event of a known kind, and for each job that timed out or was forgotten.

    ``events`` is a stream of event_id, ``key``, ts and kind: start, saved, missing or poll.
    """
    return in_order(events, key, ImportJob(limit, back_off, keep), ANSWER, delay)


class Tombstone:
    """A record that was deleted here stays hidden while the source lists it, until the source confirms."""

    def take(self, held, at, event, kind):
        if kind == "listed":
            return held, [(event, at, "hidden" if held else "shown")]
        if kind == "deleted":
            return (at,), []
        return (None if kind == "gone" else held), []

    def due(self, held):
        return None

    def lapse(self, held):
        return held, []


def shown(events: DataFrame, key: str, delay: str) -> DataFrame:
    """``key``, event_id, at and answer (shown or hidden) of every listing of a record.

    ``events`` is a stream of event_id, ``key``, ts and kind: listed, deleted, or gone, a listing without the record.
    """
    return in_order(events, key, Tombstone(), ANSWER, delay)
