"""Keyed state as a versioned table in hash buckets below a folder all executors share.

A version rewrites only the buckets that its changes touch; a small manifest, written
last, names for every bucket the version that holds it. A version that fails before
its manifest leaves nothing that readers see, and doing a version again gives the
same one. Folders that no kept manifest names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.runtime import materialize


class BucketedState:
    """Rows of one schema with a string column ``key``, one row a key.

    :param schema: DDL of the columns, ``key`` among them.
    :param buckets: number of hash buckets of a new table; so many that a task can
        rewrite one. An existing table keeps its own number.
    :param keep: versions that stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *, buckets: int = 32, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        found = self.versions()
        self.buckets = self._manifest(found[-1])[0] if found else buckets

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.lstrip("-").isdigit())

    def _manifest(self, version: int) -> tuple[int, dict[int, int]]:
        fs, p = self._path(f"manifest/{version}")
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        buckets, _, places = text.partition(";")
        return int(buckets), {int(b): int(v) for b, v in (x.split(":") for x in places.split(",") if x)}

    def _publish(self, version: int, places: dict[int, int]) -> None:
        fs, draft = self._path(f"manifest/.{version}")
        stream = fs.create(draft, True)
        stream.writeBytes(f"{self.buckets};" + ",".join(f"{b}:{v}" for b, v in sorted(places.items())))
        stream.close()
        _, p = self._path(f"manifest/{version}")
        fs.delete(p, False)
        fs.rename(draft, p)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _newest(self, upto: int | None) -> int | None:
        found = [v for v in self.versions() if upto is None or v <= upto]
        return found[-1] if found else None

    def read(self, upto: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The newest version, or the newest up to one; of some buckets, or of all. Null before the first."""
        version = self._newest(upto)
        if version is None:
            return None
        places = [f"{self.path}/data/{v}/bucket={b}" for b, v in self._manifest(version)[1].items() if only is None or b in only]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, list[str]], DataFrame], version: int) -> None:
        """Merge rows of the schema, at most few a key, into the version before and publish the result.

        :param merge: reduces rows to one a key, given them and the columns to group by.
        """
        placed = materialize(changes.withColumn("bucket", self.bucket()), "changes")
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}  # at most as many as there are buckets
        before = self._newest(version - 1)
        places = dict(self._manifest(before)[1]) if before is not None else {}
        if touched:
            old = self.read(version - 1, touched) if before is not None else None
            rows = placed if old is None else old.withColumn("bucket", self.bucket()).unionByName(placed)
            merge(rows.repartition("bucket"), ["bucket", "key"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        self._publish(version, places | {b: version for b in touched})
        self._vacuum()

    def _vacuum(self) -> None:
        found = self.versions()
        for v in found[: -self.keep]:
            fs, p = self._path(f"manifest/{v}")
            fs.delete(p, False)
        used = {v for k in found[-self.keep :] for v in self._manifest(k)[1].values()}
        fs, p = self._path("data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if int(s.getPath().getName()) not in used:
                fs.delete(s.getPath(), True)
