"""A keyed table that micro-batches update: versioned buckets under a manifest.

A batch merges its updates into the buckets of the keys that it touches and writes only those, under its own number. A
manifest then names the version of every bucket; it appears whole or not at all, so readers see either the table before
the batch or after it. A batch repeated after a failure starts from the manifest before it and gives the same table.
Manifests and buckets that neither of the two newest manifests names are removed, so files stay bounded.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.store import listed, materialize, publish, remove, scratch

BUCKETS = 16


class KeyedTable:
    """``combine`` gives each value column's aggregate over the old row and the new ones; without it new rows replace old."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], combine: dict[str, Column] | None = None,
                 buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.combine = spark, path.rstrip("/"), schema, keys, combine
        self.buckets = buckets if keys else 1

    def _manifests(self) -> list[int]:
        names = listed(self.spark, f"{self.path}/manifest")
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _versions(self, before: int | None = None) -> dict[str, int]:
        found = [n for n in self._manifests() if before is None or n < before]
        if not found:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/batch={found[-1]}", wholetext=True).first()[0])

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest table, or the one that batch ``before`` starts from."""
        return self._rows(self._versions(before))

    def merge(self, updates: DataFrame, batch: int) -> None:
        versions = self._versions(batch)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.keys else F.lit(0)
        names = [f.name for f in self.schema.fields]
        with scratch(self.spark):
            new = materialize(updates.select(*names), "updates")
            touched = sorted(r[0] for r in new.select(bucket.cast("int").alias("b")).distinct().collect())
            if touched:
                old = self._rows({str(b): versions[str(b)] for b in touched if str(b) in versions})
                if self.combine is not None:
                    rows = old.unionByName(new).groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.combine.items()])
                elif self.keys:
                    rows = old.join(new.select(*self.keys), self.keys, "left_anti").select(*names).unionByName(new)
                else:
                    rows = new
                rows.withColumn("bucket", bucket.cast("int")).repartition(len(touched), "bucket").write.partitionBy("bucket").mode(
                    "overwrite").parquet(f"{self.path}/data/version={batch}")
        publish(self.spark, json.dumps({**versions, **{str(b): batch for b in touched}}), f"{self.path}/manifest/batch={batch}")
        self._clean()

    def _clean(self) -> None:
        kept = self._manifests()[-2:]
        used = {(v, b) for n in kept for b, v in json.loads(self.spark.read.text(
            f"{self.path}/manifest/batch={n}", wholetext=True).first()[0]).items()}
        for n in set(self._manifests()) - set(kept):
            remove(self.spark, f"{self.path}/manifest/batch={n}")
        for name in listed(self.spark, f"{self.path}/data"):
            version = int(name.removeprefix("version="))
            folders = [b for b in listed(self.spark, f"{self.path}/data/{name}") if b.startswith("bucket=")]
            stale = [b for b in folders if (version, b.removeprefix("bucket=")) not in used]
            if len(stale) == len(folders):
                remove(self.spark, f"{self.path}/data/{name}")
            else:
                for b in stale:
                    remove(self.spark, f"{self.path}/data/{name}/{b}")
