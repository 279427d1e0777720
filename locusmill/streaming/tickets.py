"""Tickets that expire, held as state by key (STR-11, JN-29), and rows of which the first of a key stays (STR-03)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from locusmill.streaming.in_order import in_order


@dataclass
class Tickets:
    """The live tickets of a key, oldest first; times are microseconds."""

    issues: str
    redeems: str
    ttl: int
    capacity: int

    def take(self, held, at, event, kind):
        pairs = list(zip(*held, strict=True)) if held else []
        if kind == self.redeems:
            return held, [(event, pairs[-1][1] if pairs else None)]
        if kind != self.issues:
            return held, []
        pairs = [*pairs, (at, event)][-self.capacity :]
        return ([t for t, _ in pairs], [e for _, e in pairs]), []

    def due(self, held):
        return held[0][0] + self.ttl

    def lapse(self, held):
        issued, tickets = held[0][1:], held[1][1:]
        return ((issued, tickets) if issued else None), []


def redeemed(events: DataFrame, key: str, issues: str, redeems: str, ttl_seconds: int, capacity: int, delay: str) -> DataFrame:
    """``key``, event_id and ticket of each event of kind ``redeems``: the newest live ticket of its key, or null.

    ``events`` is a stream of event_id, ``key``, ts and kind. An event of kind ``issues`` is a
    ticket; it lives for ``ttl_seconds``, and of a key at most ``capacity`` are held, the oldest go
    first. A key whose tickets are all dead holds nothing.
    """
    answer = StructType([StructField("event_id", LongType()), StructField("ticket", LongType())])
    return in_order(events, key, Tickets(issues, redeems, ttl_seconds * 1_000_000, capacity), answer, delay)
