"""Sharding by a permutation-filled lookup table, in DataFrame and SQL functions only.

Each shard orders the slots of a table of prime size by a permutation of its own (an offset and
a step from hashes of its name). In turns the shards claim the first free slot of their order
until the table is full, so shards differ by one slot at most and a lost shard moves few others.
A row's slot is its key's hash modulo the size. The table has ``size`` rows whatever the data, so
it is broadcast and placement takes constant time.

Defined cases: a null key hashes as the empty string; equal keys share a shard; an empty table
gives no rows; all columns of the input stay, and the added ones must not clash (the operator
says so before it runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SIZE = 2039
#: The table goes to every executor and its fill takes size x size x shards cheap steps.
MOST_SLOTS = 20_011


def _hash(text: Column, salt: str) -> Column:
    """60 bits of MD5 as a non-negative bigint, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 15), 16, 10).cast("bigint")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """slot int, shard string: ``size`` rows."""
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    names = F.array(*map(F.lit, shards))
    offsets = F.transform(names, lambda name: _hash(name, "offset:") % size)
    skips = F.transform(names, lambda name: _hash(name, "skip:") % (size - 1) + 1)
    one = spark.range(1).select(names.alias("names"), offsets.alias("offsets"), skips.alias("skips"))
    n = len(shards)

    def step(state: Column, _: Column) -> Column:
        """The shard whose turn it is looks at the slot under its cursor: it claims a free one, or moves on."""
        own = state["turn"] % n
        slot = ((F.get("offsets", own) + state["at"] * F.get("skips", own)) % size).cast("int")
        free = F.substring(state["taken"], slot + 1, F.lit(1)) == F.lit(b"\0")
        moved = F.concat(F.slice(state["cursors"], F.lit(1), own), F.array(state["at"] + 1), F.slice(state["cursors"], own + 2, F.lit(n)))
        claimed = F.struct(
            (state["turn"] + 1).alias("turn"), F.get(moved, (state["turn"] + 1) % n).alias("at"), moved.alias("cursors"),
            F.overlay(state["taken"], F.lit(b"\1"), slot + 1, F.lit(1)).alias("taken"), F.concat(state["claims"], F.array(slot)).alias("claims"),
        )
        passed = state.withField("at", state["at"] + 1)
        return F.when(state["turn"] >= size, state).when(free, claimed).otherwise(passed)

    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(0).alias("turn"), zero.alias("at"), F.array_repeat(zero, n).alias("cursors"),
        F.unhex(F.repeat(F.lit("00"), F.lit(size))).alias("taken"), F.expr("cast(array() as array<int>)").alias("claims"),
    )
    # No cursor passes more than all slots; once all are claimed, a step does nothing.
    claims = one.select("names", F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(n * size).cast("bigint")), start, step, lambda s: s["claims"]).alias("claims"))
    return claims.select("names", F.posexplode("claims").alias("turn", "slot")).select("slot", F.get("names", F.col("turn") % n).alias("shard"))


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """Adds slot int and shard string to every row."""
    if clash := {"slot", "shard"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    slot = (_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), "key:") % size).cast("int")
    table = lookup_table(rows.sparkSession, shards, size)
    return rows.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard")
