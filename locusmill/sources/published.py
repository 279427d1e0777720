"""Tables that are published all or not at all (SNK-01, SNK-06, STR-09).

The parts of a batch are written to a folder of their own; then one small manifest names it, moved to
its place in one step that fails where a manifest of that batch is. Readers take the folders that manifests name
and nothing else. So a batch that fails half-way leaves no record, one that is run again adds
none, and of two runs at once one wins. What a failed run left behind is never read; ``swept`` deletes it.

The driver reads one short line for each batch. ``compacted`` puts many batches into one.
Defined cases: before the first batch there are no rows; a batch with no rows is published like others; a
batch must have the parts that the table has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Published:
    """The parts of a table below a path, each with its schema."""

    def __init__(self, spark: SparkSession, path: str, parts: dict[str, StructType]) -> None:
        self._spark, self._path, self._parts = spark, path.rstrip("/"), parts
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self._path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, batch: int | str, parts: dict[str, DataFrame]) -> bool:
        """Writes all parts of a batch, then publishes them; False if the batch was published already."""
        if set(parts) != set(self._parts):
            raise ValueError(f"a batch has the parts {sorted(self._parts)}")
        if str(batch) in self._manifests():
            return False
        folder = f"{self._path}/data/{uuid.uuid4().hex}"
        for name, df in parts.items():
            columns = [df[f.name].cast(f.dataType).alias(f.name) for f in self._parts[name].fields]
            df.select(*columns).write.parquet(f"{folder}/{name}")
        return self._put_manifest(str(batch), {"folder": folder, "replaces": []})

    def read(self, name: str) -> DataFrame:
        """The rows of a part over all published batches."""
        folders = [f"{folder}/{name}" for folder in self._folders()]
        if not folders:
            return self._spark.createDataFrame([], self._parts[name])
        return self._spark.read.schema(self._parts[name]).parquet(*folders)

    def batches(self) -> list[str]:
        """The batches that are published, those that were put together included."""
        return sorted(self._manifests())

    def compacted(self, label: str) -> bool:
        """One batch in place of all that are published; these stay known, so that none is published again."""
        replaced = sorted({m["folder"] for m in self._manifests().values()})
        folder = f"{self._path}/data/{uuid.uuid4().hex}"
        for name in self._parts:
            self.read(name).write.parquet(f"{folder}/{name}")
        return self._put_manifest(label, {"folder": folder, "replaces": replaced})

    def swept(self) -> int:
        """Deletes folders that no manifest names; how many. Only for times at which nothing is being published."""
        kept = set(self._folders())
        at = self._hadoop(f"{self._path}/data")
        gone = [f.getPath() for f in (self._files.listStatus(at) if self._files.exists(at) else []) if f.getPath().getName() not in {k.rsplit("/", 1)[1] for k in kept}]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)

    def _folders(self) -> list[str]:
        manifests = list(self._manifests().values())
        replaced = {f for m in manifests for f in m["replaces"]}
        return sorted({m["folder"] for m in manifests} - replaced)

    def _manifests(self) -> dict[str, dict]:
        at = self._hadoop(f"{self._path}/manifests")
        if not self._files.exists(at):
            return {}
        return dict(self._read_manifests(at))

    def _read_manifests(self, at) -> Iterator[tuple[str, dict]]:
        for file in self._files.listStatus(at):
            name = file.getPath().getName()
            if name.endswith(".json") and not name.startswith("_"):
                lines = self._spark.sparkContext._jvm.scala.io.Source.fromInputStream(self._files.open(file.getPath()), "UTF-8")
                held = json.loads(lines.mkString())
                lines.close()
                yield held["batch"], held

    def _put_manifest(self, batch: str, held: dict) -> bool:
        """In one step: a rename to a place that is taken does nothing."""
        waiting = self._hadoop(f"{self._path}/manifests/_{uuid.uuid4().hex}")
        out = self._files.create(waiting, False)
        out.write(bytearray(json.dumps({"batch": batch, **held}).encode()))
        out.close()
        place = self._hadoop(f"{self._path}/manifests/{batch}.json")
        if not self._files.exists(place) and self._files.rename(waiting, place):
            return True
        self._files.delete(waiting, False)
        return False
