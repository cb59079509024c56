"""Applying inserts, updates and deletes that arrive repeatedly and out of order.

Of each key the state keeps the sequence number of the last change, of the last
one that brought the record into being and of the last that ended it (the
tombstone), and the payload of the last change. A change only counts if it is
newer than what the state knows, so repeats and late arrivals are harmless, and
states merge by maxima: a batch is first reduced on the map side, whatever the
share of its hottest key, and then merged into the keyed state. A late update
can't revive a record, and a late create below known updates makes them count.

``ChangeTable`` writes one version of the state per micro-batch, named by batch
id, in which only the hash buckets that the batch touches are new. Replaying a batch
after a failure rewrites the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.streaming.keyed_state import BucketedState

STATE = ["key", "last_seq", "born_seq", "gone_seq", "payload"]
_BLANKS = r"^[\s ​﻿]+|[\s ​﻿]+$"


def clean_op(op: Column) -> Column:
    return F.lower(F.regexp_replace(op, _BLANKS, ""))


def reduce_changes(changes: DataFrame, key: str, seq: str, op: str, payload: str | None = None, *, creates: tuple[str, ...] = ("create",), ends: tuple[str, ...] = ("purge",)) -> DataFrame:
    """State rows (STATE columns) of a batch of changes.

    Changes without key or seq are ignored; a null op counts as an update. Of
    changes with the same key and seq, repeats of one change, the greatest payload
    is kept, so that the result doesn't depend on the order of arrival.
    """
    kind = clean_op(F.col(op))
    rows = changes.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), kind.alias("op"), *([F.col(payload).alias("payload")] if payload else [])).filter("key is not null and seq is not null")
    last = F.max(F.struct("seq", "payload")).getField("payload") if payload else F.lit(None).cast("string")
    return rows.groupBy("key").agg(
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("op").isin(*creates), F.col("seq"))).alias("born_seq"),
        F.max(F.when(F.col("op").isin(*ends), F.col("seq"))).alias("gone_seq"),
        last.alias("payload"),
    )


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """States of the same key as one: later changes win, whatever the order they came in."""
    return rows.groupBy(*by).agg(
        F.max("last_seq").alias("last_seq"),
        F.max("born_seq").alias("born_seq"),
        F.max("gone_seq").alias("gone_seq"),
        F.max(F.struct("last_seq", "payload")).getField("payload").alias("payload"),
    )


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state after both; commutative, associative and idempotent."""
    return _merged(a.select(*STATE).unionByName(b.select(*STATE)), ["key"]).select(*STATE)


def current_rows(state: DataFrame) -> DataFrame:
    """key, seq, payload of the records that exist: born, and not ended since."""
    return state.filter("born_seq is not null and (gone_seq is null or gone_seq < born_seq)").select("key", F.col("last_seq").alias("seq"), "payload")


class ChangeTable:
    """The keyed state as bucketed versions below a folder all executors share, one version a batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, op: str, payload: str | None = None, *, buckets: int = 32):
        self.columns = (key, seq, op, payload)
        self.table = BucketedState(spark, path, "key string, last_seq long, born_seq long, gone_seq long, payload string", buckets=buckets)

    def state(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or the newest up to the given one."""
        return self.table.read(version)

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Merge a batch into the buckets it touches; applying the same batch again gives the same version."""
        self.table.update(reduce_changes(changes, *self.columns), _merged, batch_id)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a streaming query that keeps the table."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def current(self) -> DataFrame | None:
        state = self.state()
        return None if state is None else current_rows(state)
