"""A table with a key, in hash buckets: an upsert rewrites the buckets that it touches and publishes them by one rename.

The folder holds `data/<write>/bucket=<b>/` and `manifest/<version>.json`, which names the folder of each bucket. A reader takes the
latest manifest; a write that dies before its manifest is renamed into place leaves the table as it was, and one that finds its
version taken has lost to another writer and fails. A write with an id that the table has seen is skipped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import _folder


class Conflict(RuntimeError):
    """Another write has published this version first."""


def latest(rows: DataFrame, key: str, version: str, later: str | None = None) -> DataFrame:
    """The row of greatest version of each key; of equals that of greatest `later`, then by a hash of all columns. Nulls come first,
    a null key is a key of its own. Tasks keep one row for each key before they are shuffled, so a hot key is no burden."""
    own = [c for c in rows.columns if c != later]
    order = F.struct(version, *([later] if later else []), F.xxhash64(*own).alias("hash"))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*own), order).alias("__row")).select("__row.*")


class KeyedTable:
    """A table at a path with a key column, a column of versions, and a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, version: str, buckets: int = 256) -> KeyedTable:
        """An empty table; the one that is there already, if it has the same key and columns."""
        try:
            held = cls.open(spark, path)
            if (held.manifest["key"], held.manifest["schema"]) != (key, schema.jsonValue()):
                raise ValueError("another table is there")
            return held
        except FileNotFoundError:
            table = cls(spark, path, {"number": -1, "key": key, "version": version, "buckets": buckets, "schema": schema.jsonValue(), "places": {}, "writes": []})
            return table._publish(table.manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        """The table as its latest manifest has it."""
        folder, files = _folder(spark, f"{path}/manifest")
        names = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")] if files.exists(folder) else []
        if not names:
            raise FileNotFoundError(path)
        last = max(names, key=lambda p: p.getName())
        text = spark.read.option("wholetext", True).text(last.toString()).first()[0]
        return cls(spark, path, json.loads(text))

    def _publish(self, manifest: dict) -> KeyedTable:
        manifest = manifest | {"number": manifest["number"] + 1}
        to, files = _folder(self.spark, f"{self.path}/manifest/{manifest['number']:012d}.json")
        draft, _ = _folder(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        files.mkdirs(to.getParent())
        out = files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(to) or not files.rename(draft, to):
            files.delete(draft, False)
            raise Conflict(f"version {manifest['number']} of {self.path} is taken")
        return KeyedTable(self.spark, self.path, manifest)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        places = [p for b, p in self.manifest["places"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in places]) if places else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.manifest["key"])), F.lit(self.manifest["buckets"])).cast("int")

    def find(self, keys: list) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        frame = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.manifest["key"]]]))
        held = {r[0] for r in frame.select(self.bucket()).distinct().collect()}
        return self.read(sorted(held)).join(F.broadcast(frame), self.manifest["key"], "left_semi") if held else self.read([])

    def upsert(self, new: DataFrame, write: str | None = None) -> KeyedTable:
        """The table with new rows in it: of each key the row of greatest version, at equal versions the new one. Buckets that no new row
        falls into keep their files. The driver gets the numbers of the touched buckets, at most as many as there are."""
        if write is not None and write in self.manifest["writes"]:
            return self
        m = self.manifest
        new = new.select([F.col(f.name).cast(f.dataType) for f in self.schema])
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())
        places = dict(m["places"])
        if touched:
            both = self.read(touched).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
            place = f"data/{uuid.uuid4().hex}"
            rows = latest(both, m["key"], m["version"], "__new").withColumn("__bucket", self.bucket())
            rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{place}")
            places |= {str(b): f"{place}/__bucket={b}" for b in touched}
        return self._publish(m | {"places": places, "writes": [*m["writes"], *([write] if write is not None else [])][-1000:]})

    def clean(self) -> int:
        """Remove folders of writes that the latest manifest doesn't name; how many. No reader of older ones may be at work."""
        top, files = _folder(self.spark, f"{self.path}/data")
        held = {p.split("/")[1] for p in self.manifest["places"].values()}
        old = [s.getPath() for s in files.listStatus(top) if s.getPath().getName() not in held] if files.exists(top) else []
        for p in old:
            files.delete(p, True)
        return len(old)
