"""The store of reported issues: what is kept of a report, exports and imports (ARR-11, ARR-12, SRC-13, SRC-14, SNK-05, SET-07).

Defined cases: texts that are no JSON object give null; an envelope of another format or with too
many records gives none; an issue that is known already is left out; equal incoming ones count once.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from locusmill.functions.text import SECRET_NAME

FORMAT, MOST_RECORDS, MOST_BYTES = "locusmill-issues", 500, 4 << 20
DEPTH, MOST_ITEMS, MOST_KEYS = 9, 120, 100
_SECRET = re.compile(SECRET_NAME)
_ADDRESS = re.compile(r"^(https?://)(?:[^/?#@]*@)?([^?#]*)[^#]*", re.I)


def without_secrets(value: object, depth: int = DEPTH) -> object:
    """A JSON value of bounded depth and width, without fields that look like secrets; addresses lose users and queries."""
    if isinstance(value, dict):
        kept = [(k, v) for k, v in value.items() if not _SECRET.search(k)][:MOST_KEYS] if depth else []
        return {k: without_secrets(v, depth - 1) for k, v in kept}
    if isinstance(value, list):
        return [without_secrets(v, depth - 1) for v in value[:MOST_ITEMS]] if depth else []
    return _ADDRESS.sub(r"\1\2", value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def cleaned(documents: pd.Series) -> pd.Series:
    """JSON objects as ``without_secrets`` leaves them, keys sorted; null for anything else."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text or "")
        except ValueError:
            return None
        return json.dumps(without_secrets(value), sort_keys=True, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None

    return documents.map(one)


def evidence(fields: dict[str, int], most: int = 90_000) -> Column:
    """The named text columns cut to their lengths, as JSON with a flag for what was cut; null beyond ``most`` characters."""
    cut = [F.left(F.col(c), F.lit(n)).alias(c) for c, n in fields.items()]
    truncated = F.lit(False)
    for c, n in fields.items():
        truncated = truncated | F.coalesce(F.length(c) > n, F.lit(False))
    made = F.to_json(F.struct(*cut, truncated.alias("truncated")))
    return F.when(F.length(made) <= most, made)


def exported(issues: DataFrame, group: str, order: list[str], version: str) -> DataFrame:
    """``group`` and envelope: the format, its version and the records of a group as one JSON text.

    A group of more than ``MOST_RECORDS`` is refused (a null envelope), never cut; no more rows than
    one beyond that are brought together.
    """
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    some = issues.withColumn("_k", place).where(F.col("_k") <= MOST_RECORDS + 1)
    record = F.struct(*(c for c in issues.columns if c != group))
    rows = some.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_k", record.alias("r")))), lambda s: s["r"]).alias("records"))
    envelope = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(1).alias("schemaVersion"), F.lit(version).alias("version"), "records"))
    return rows.select(group, F.when((F.col("_n") <= MOST_RECORDS) & (F.length(envelope) <= MOST_BYTES), envelope).alias("envelope"))


def imported(envelopes: DataFrame, known: DataFrame, record: str) -> DataFrame:
    """The records (schema ``record``, with id, fingerprint and occurrences) of JSON envelopes that ``known`` (id, fingerprint) lacks.

    Known issues are never changed. An id that is taken gets a new one from its fingerprint, and
    occurrences lie from 1 to 10^9.
    """
    parsed = envelopes.select(F.from_json("envelope", f"format string, schemaVersion int, records array<struct<{record}>>").alias("e"))
    usable = parsed.where((F.col("e.format") == FORMAT) & (F.col("e.schemaVersion") == 1) & (F.size("e.records") <= MOST_RECORDS))
    rows = usable.select(F.inline("e.records")).where("fingerprint is not null")
    columns = rows.columns
    rows = rows.withColumn("occurrences", F.least(F.greatest(F.coalesce("occurrences", F.lit(1)), F.lit(1)), F.lit(1_000_000_000)))
    rows = rows.groupBy("fingerprint").agg(F.min(F.struct("id", *(c for c in columns if c not in ("id", "fingerprint")))).alias("_r")).select("fingerprint", "_r.*")
    fresh = rows.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    taken = known.select("id").distinct().withColumn("_taken", F.lit(True))
    again = F.row_number().over(W.partitionBy("id").orderBy("fingerprint")) > 1
    fresh = fresh.withColumn("_again", again).join(taken, "id", "left")
    new = F.when(F.col("_again") | F.coalesce("_taken", F.lit(False)) | F.col("id").isNull(), F.concat(F.lit("i-"), F.left("fingerprint", F.lit(12)))).otherwise(F.col("id"))
    return fresh.withColumn("id", new).select(*columns)
