"""The master table kept up to date delivery by delivery.

Rows lie in folders by a hash of their keys. A delivery touches the folders of its keys only: their old rows and the new ones are merged by the rule of
``master_table`` and written to new folders; all others stay as they are. A manifest names the folders of a version and is put in place by one
rename after everything is written, so readers see the old table or the new one, and a run that is lost leaves the old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.model import FEATURE_KEYS
from paceline.operators.master import first_of_each, union_features
from paceline.session import cut, file_system, scratch

BUCKETS = 64


class VersionedMaster:
    """A master table below ``path``. ``rank`` orders the origins: of rows with equal keys the one of the lowest rank stays."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = FEATURE_KEYS, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _manifests(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folders(self) -> dict[int, str]:
        """Folder of every bucket in the latest version."""
        versions = self._manifests()
        if not versions:
            return {}
        (line,) = self.spark.read.text(f"{self.path}/manifests/{versions[-1]}.json", wholetext=True).collect()
        return {int(k): v for k, v in json.loads(line["value"]).items()}

    def _rows(self, folders: Sequence[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        """The latest version; None before the first delivery."""
        rows = self._rows(sorted(self.folders().values()))
        return None if rows is None else rows.drop("__rank")

    def deliver(self, rows: DataFrame, rank: int) -> list[int]:
        """Merges ``rows`` of the origin ``rank``; returns the buckets that were written."""
        with scratch(self.spark):
            bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
            new = cut(rows.withColumns({"__rank": F.lit(rank), "__bucket": bucket}))
            touched = sorted(r["__bucket"] for r in new.select("__bucket").distinct().collect())  # at most `buckets`
            if not touched:
                return []
            now = self.folders()
            old = self._rows([now[b] for b in touched if b in now])
            both = new if old is None else union_features([old.withColumn("__bucket", bucket), new])
            place = f"{self.path}/data/{uuid.uuid4().hex}"
            merged = first_of_each(both, [*self.keys, "__bucket"], keep_rank=True)
            merged.repartition("__bucket").write.partitionBy("__bucket").parquet(place)
            self._publish(now | {b: f"{place}/__bucket={b}" for b in touched})
        return touched

    def _publish(self, folders: dict[int, str]) -> None:
        version = (self._manifests() or [0])[-1] + 1
        fs, target = file_system(self.spark, f"{self.path}/manifests/{version}.json")
        fs.mkdirs(target.getParent())
        _, draft = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(draft, target):
            raise RuntimeError(f"version {version} was written by someone else meanwhile")

    def clean(self) -> int:
        """Deletes folders that the latest version does not name; returns how many. Not while others read older versions."""
        fs, data = file_system(self.spark, f"{self.path}/data")
        named, gone = {f.rsplit("/data/", 1)[1] for f in self.folders().values()}, 0
        for run in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    gone += bool(fs.delete(part.getPath(), True))
        return gone
