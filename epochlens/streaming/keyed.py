"""Tables of keyed rows that triggers update bucket by bucket.

Rows lie in folders by a hash of their key. A version is a folder with the buckets that one trigger rewrote, and a
manifest that names, for every bucket, the version that holds it. The manifest is written last and counts only when it is complete,
so readers see the state before a trigger or after it; a trigger that is replayed starts from the manifest before its own
and writes the same again. A manifest has a row for each bucket and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The buckets that rows fall into; `buckets` numbers at most."""
    return sorted(r["bucket"] for r in rows.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())


def complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders v<number> under `path` whose writing has ended."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName()[1:]) for p in folders if p.getName().startswith("v") and fs.exists(hadoop.Path(p, "_SUCCESS")))


@dataclass(frozen=True)
class KeyedTable:
    """A table under `path` with one row for each value of `keys`, in a fixed number of buckets."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to version, as of the last complete version (below `before`)."""
        versions = [v for v in complete(self.spark, f"{self.path}/manifest") if before is None or v < before]
        if not versions:
            return {}
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/v{versions[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, manifest: dict[int, int] | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: no file of another bucket is opened."""
        held = self.manifest() if manifest is None else manifest
        wanted = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def rewrite(self, version: int, manifest: dict[int, int], rows: DataFrame, buckets: Sequence[int]) -> None:
        """Make `rows` the whole content of `buckets` and switch to the new version."""
        placed = rows.withColumn("bucket", bucket_of(self.keys, self.buckets))
        data = f"{self.path}/data/v{version}"
        placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(data)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(data)
        names = [s.getPath().getName() for s in hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
        full = {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}
        now = {b: v for b, v in manifest.items() if b not in buckets} | dict.fromkeys(sorted(full), version)
        listing = self.spark.createDataFrame(sorted(now.items()), "bucket int, version bigint")
        listing.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
