"""A table of the latest row per key in which an upsert touches only what changed.

Keys are dealt to buckets by their hash; a bucket is a folder of versions, and a small manifest says which version of each
bucket is live. An upsert reads and writes only the buckets that hold a new key, beside the files of all others, and becomes
visible when its manifest is renamed into place. A batch that failed on the way leaves nothing that is read; its rerun
overwrites what it left. A batch that is already in the manifest is skipped. The version before the live one stays for readers
that have begun; older ones go.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.operators.state import latest

BUCKET, VERSION = "key_bucket", "key_version"


class KeyedTable:
    """``buckets`` is fixed when a table is begun; a bucket is one task's work, so it grows with the rows that are expected."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/_manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_manifests/{name}", wholetext=True).first()[0])

    def state(self) -> dict:
        """{batch, versions (bucket to version)} of the live table; batch is -1 before the first."""
        names = self._manifests()
        return self._manifest(names[-1]) if names else {"batch": -1, "versions": {}}

    def _folder(self, bucket: str, version: str) -> str:
        return f"{self.path}/{BUCKET}={bucket}/{VERSION}={version}"

    def _rows(self, live: dict, buckets: list[str]) -> DataFrame | None:
        paths = [self._folder(b, live["versions"][b]) for b in buckets if b in live["versions"]]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None  # no more paths than buckets

    def read(self) -> DataFrame | None:
        """The live rows; None before the first batch."""
        live = self.state()
        return self._rows(live, sorted(live["versions"]))

    def upsert(self, new: DataFrame, batch: int | None = None) -> list[str]:
        """Merge the latest rows by key in; gives the buckets that were written. ``batch`` numbers ascend; without one the next is taken."""
        live = self.state()
        batch = live["batch"] + 1 if batch is None else batch
        if batch <= live["batch"]:
            return []
        dealt = new.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)))
        touched = sorted(str(r[0]) for r in dealt.select(BUCKET).distinct().collect())  # no more than buckets
        if touched:
            old = self._rows(live, touched)
            both = dealt if old is None else old.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))).unionByName(dealt, allowMissingColumns=True)
            own = both.repartition(len(touched), BUCKET)  # a bucket's rows are grouped where they are
            merged = latest(own, [BUCKET, *self.key], self.order).withColumn(VERSION, F.lit(batch))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(self.path)
        self._commit(batch, {**live["versions"], **dict.fromkeys(touched, str(batch))})
        self._clean()
        return touched

    def _commit(self, batch: int, versions: dict[str, str]) -> None:
        temporary = f"{self.path}/_manifests/_{uuid.uuid4().hex}"
        fs, at = self._fs(temporary)
        out = fs.create(at, True)
        out.write(json.dumps({"batch": batch, "versions": versions}).encode())
        out.close()
        if not fs.rename(at, self._fs(f"{self.path}/_manifests/{batch:012d}.json")[1]):
            raise RuntimeError(f"batch {batch} of {self.path} was committed by another writer")

    def _clean(self) -> None:
        """Versions and manifests that neither the live manifest nor the one before it names."""
        names = self._manifests()
        if len(names) < 3:
            return
        kept = {(b, v) for n in names[-2:] for b, v in self._manifest(n)["versions"].items()}
        for name in names[:-2]:
            for bucket, version in self._manifest(name)["versions"].items():
                if (bucket, version) not in kept:
                    fs, at = self._fs(self._folder(bucket, version))
                    fs.delete(at, True)
            fs, at = self._fs(f"{self.path}/_manifests/{name}")
            fs.delete(at, False)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a session of one machine has /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(named or "/tmp/checkpoints", f"{label}-{uuid.uuid4().hex}")
