"""Time travel over a version log, and the change feed as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HistoryError(ValueError):
    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


def as_of(log: DataFrame, seq: int | DataFrame, *, space: str | None = None) -> DataFrame:
    """(space, element, seq, version, row) of the elements that exist at a coordinate.

    :param log: space, element, seq, version, op, row; repeats allowed.
    :param seq: the coordinate, or a table (space, seq) of one for each space.
    The greatest (seq, version) up to it is an element's row; a null row or a purge is
    none. Later created elements are absent. Reduced on the map side by maxima.
    """
    if space is not None:
        log = log.filter(F.col("space") == space)
    past = log.filter(F.col("seq") <= seq) if isinstance(seq, int) else log.join(seq.select("space", F.col("seq").alias("_at")), "space").filter(F.col("seq") <= F.col("_at"))
    last = past.groupBy("space", "element").agg(F.max(F.struct("seq", "version", F.lower(F.trim("op")).alias("op"), "row")).alias("v")).select("space", "element", "v.*")
    return last.filter("op <> 'purge' and row is not null").drop("op")


def seq_of_tx(journal: DataFrame, tx_id: str) -> tuple[str, int]:
    found = journal.filter((F.col("tx_id") == tx_id) & F.col("seq").isNotNull()).select("space", "seq").first()
    if not found:
        raise HistoryError(f"no transaction {tx_id}", "TransactionUnknown")
    return found.space, int(found.seq)


def seqs_at(journal: DataFrame, at) -> DataFrame:
    """(space, seq) of each space's last commit up to a time; spaces that begin later are at 0."""
    seen = F.max(F.when(F.col("committed_at") <= at, F.col("seq")))
    return journal.filter("seq is not null").groupBy("space").agg(F.coalesce(seen, F.lit(0)).cast("long").alias("seq"))


def snapshot(journal: DataFrame, space: str, seq: int) -> str:
    """The token of a coordinate; one the space hasn't reached is refused."""
    top = journal.filter(F.col("space") == space).agg(F.max("seq")).first()[0] or 0
    if seq > top:
        raise HistoryError(f"{space} is at {top}", "HistoricalSnapshotUnavailable")
    return f"{space}:{seq}"


def element_history(log: DataFrame, element: str, low: int = 0, high: int | None = None) -> DataFrame:
    """The distinct changes of one element in a range, in order."""
    rows = log.filter((F.col("element") == element) & (F.col("seq") >= low))
    rows = rows if high is None else rows.filter(F.col("seq") <= high)
    return rows.groupBy("element", "seq").agg(F.max("version").alias("version"), F.max(F.lower(F.trim("op"))).alias("op")).orderBy("seq")


def changes(journal: DataFrame, space: str, after: int, limit: int = 100) -> DataFrame:
    """Commits of a space after a coordinate, in order; the last seq delivered is the next cursor."""
    rows = journal.filter((F.col("space") == space) & (F.col("seq") > after)).select("seq", "tx_id", "status", "committed_at").distinct()
    return rows.orderBy("seq", "tx_id").limit(limit)


def space_history(log: DataFrame, space: str, low: int = 0, high: int | None = None, *, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(seq, element, version, op): the distinct changes of a space in a range of its commits, in order, as pages."""
    rows = log.filter((F.col("space") == space) & (F.col("seq") >= low))
    rows = rows if high is None else rows.filter(F.col("seq") <= high)
    out = rows.groupBy("seq", "element").agg(F.max("version").alias("version"), F.max(F.lower(F.trim("op"))).alias("op")).orderBy("seq", "element")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def visible_changes(log: DataFrame, readable: DataFrame) -> DataFrame:
    """(space, seq, element): the distinct changes of elements that a reader may see (a table with ``element``)."""
    seen = readable.select("element").dropna().distinct()
    return log.select("space", "seq", "element").join(seen, "element", "left_semi").select("space", "seq", "element").distinct()


def transactions(journal: DataFrame, *, ids: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(tx_id, space, seq, status, idempotency_key) of the commits with one of the ids (``tx_id``) or idempotency keys."""
    rows = journal.select("tx_id", "space", "seq", "status", "idempotency_key").distinct()
    if ids is not None:
        rows = rows.join(ids.select("tx_id").dropna().distinct(), "tx_id", "left_semi")
    if keys is not None:
        rows = rows.join(keys.select("idempotency_key").dropna().distinct(), "idempotency_key", "left_semi")
    return rows.select("tx_id", "space", "seq", "status", "idempotency_key")


def schema_at(packages: DataFrame, seq: int) -> DataFrame:
    """(package, version): the schema in force at a coordinate, from rows package, version, from_seq: of each package the last up to it."""
    return packages.filter(F.col("from_seq") <= seq).groupBy("package").agg(F.max_by("version", "from_seq").alias("version"))


def bound(journal: DataFrame, token: str, seq: int | None = None) -> tuple[str, int]:
    """(space, seq) that reads under a snapshot token are made at; a coordinate named besides must agree."""
    space, _, at = token.rpartition(":")
    if not space or not at.isdigit():
        raise HistoryError(f"no snapshot {token}", "HistoricalSnapshotUnavailable")
    if seq is not None and seq != int(at):
        raise HistoryError(f"the snapshot is at {at}, not {seq}", "SnapshotConflict")
    snapshot(journal, space, int(at))
    return space, int(at)
