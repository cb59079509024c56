"""References to records that do not exist, as incrementally kept keyed state.

The state is an index by key in hash buckets: is the record there, and does any
reference name it. A key that is named and not there has its references waiting.
References themselves stand in a log, one part an epoch, and are never rewritten:

* new references mark their targets in the index, once a target;
* records that arrive resolve the references waiting for them;
* deletions reopen references that had been resolved.

All three change the target's one row in the index, whatever the number of
references to it, and an epoch rewrites only the buckets that its keys fall into.
Only the waiting references are read from the log, for reports and snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.streaming.keyed_state import BucketedState

REFERENCE = ["source_table", "source_field", "source_id", "target_id", "period"]
_INDEX = "key string, alive boolean, at long, named boolean"
#: events without a time come before all others
_EARLIEST = -(2**62)


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last event of a key counts, of simultaneous ones an arrival; once named it stays named."""
    last = F.max(F.when(F.col("alive").isNotNull(), F.struct("at", "alive")))
    return rows.groupBy(*by).agg(last.getField("alive").alias("alive"), last.getField("at").alias("at"), F.max("named").alias("named"))


class OrphanState:
    """Pending orphans below a folder all executors share; ``references`` has the REFERENCE columns."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 32, keep: int = 2):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = BucketedState(spark, f"{self.path}/index", _INDEX, buckets=buckets, keep=keep)

    def epoch(self) -> int:
        return max([0, *self.index.versions()])

    def advance(self, references: DataFrame, records: DataFrame) -> int:
        """Take in the next epoch and return its number; one that failed half way is done again in full.

        :param references: the REFERENCE columns; null targets are no references and
            repeated ones count once, within an epoch and across. Further columns are ignored.
        :param records: key, alive (false: a deletion), at (order of the events of a
            key; of equal ones an arrival wins; null counts as the earliest). Null
            keys are ignored.
        """
        epoch = self.epoch() + 1
        log = f"{self.path}/references/{epoch}"
        references.select(*REFERENCE).filter(F.col("target_id").isNotNull()).write.mode("overwrite").parquet(log)
        named = self.spark.read.schema(self._schema(references)).parquet(log).select(F.col("target_id").alias("key"), F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("named"))
        events = records.filter(F.col("key").isNotNull()).select("key", F.coalesce("alive", F.lit(False)).alias("alive"), F.coalesce(F.col("at").cast("long"), F.lit(_EARLIEST)).alias("at"), F.lit(False).alias("named"))
        self.index.update(_merged(named.unionByName(events), ["key"]), _merged, epoch)
        return epoch

    @staticmethod
    def _schema(references: DataFrame):
        return references.select(*REFERENCE).schema

    def references(self, epoch: int | None = None) -> DataFrame:
        """All references of the epochs up to one, as often as they came."""
        last = self.epoch() if epoch is None else epoch
        return self.spark.read.parquet(*[f"{self.path}/references/{i}" for i in range(1, last + 1)])

    def waiting(self, epoch: int | None = None) -> DataFrame:
        """(target_id) that references name and that are not there."""
        return self.index.read(epoch).filter("named and not coalesce(alive, false)").select(F.col("key").alias("target_id"))

    def orphans(self, epoch: int | None = None) -> DataFrame:
        """The references that wait for a target, one row each; of repeated ones the earliest period."""
        found = self.references(epoch).join(self.waiting(epoch), "target_id", "left_semi")
        return found.groupBy(*REFERENCE[:4]).agg(F.min("period").alias("period"))

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        """Waiting and all references per table, field and period, as of an epoch."""
        last = self.epoch() if epoch is None else epoch
        waits = self.waiting(last).withColumn("waits", F.lit(1).cast("long"))
        every = self.references(last).groupBy(*REFERENCE[:4]).agg(F.min("period").alias("period")).join(waits, "target_id", "left")
        counted = every.groupBy("source_table", "source_field", "period").agg(F.coalesce(F.sum("waits"), F.lit(0)).alias("orphans"), F.count("*").alias("refs"))
        return counted.withColumn("epoch", F.lit(last).cast("long"))
