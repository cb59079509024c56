"""Processing only new or changed records, by Merkle trees over key ranges.

A leaf covers a range of one space's sequence numbers; its digest is the sum of
the hashes of the distinct records in it, so leaves are made by partial
aggregation and digests do not depend on the order of rows. Inner nodes digest
their children. Two trees are compared from the roots down: only below nodes that
differ are the children looked at, and only differing leaves' records are read
and compared one by one. Output and tree are published under one version, the
marker last; a run that fails before leaves nothing behind that later runs see.

A reader whose earlier runs left a ledger of ranges instead of a tree is taken over
by ``adopt``: one pass makes the tree of what those runs took, from then on it counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.runtime import materialize

#: a record is (space, seq, element); a leaf has LEAF sequence numbers, an inner node FAN children
LEAF, FAN = 64, 16
RECORD = ["space", "seq", "element"]


def _matched(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A semi or anti join in which nulls are equal: a space may be null."""
    b = b.select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in columns]), how)


def leaf_of(seq) -> F.Column:
    return F.floor(seq / LEAF).cast("long")


def _digest(content: list[str], where: Column | None = None) -> Column:
    # sums of 64-bit hashes in 128 bits: no overflow below 2**60 records
    h = F.xxhash64(*RECORD, *content).cast("decimal(38,0)")
    return F.sum(h if where is None else F.when(where, h))


def leaves(records: DataFrame, content: list[str] = ()) -> DataFrame:
    """(space, level 0, node, n, digest) of distinct records; ``content`` columns count as well."""
    return records.groupBy("space", leaf_of(F.col("seq")).alias("node")).agg(F.count("*").alias("n"), _digest(list(content)).alias("digest")).select("space", F.lit(0).alias("level"), "node", "n", "digest")


def _grown(level: DataFrame) -> DataFrame:
    """All levels above the given leaves."""
    tree, top = level, level.agg(F.max("node")).first()[0]
    depth = 0
    while top is not None and top > 0:
        depth += 1
        level = level.groupBy("space", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(
            F.sum("n").alias("n"), F.sum(F.xxhash64("node", "n", "digest").cast("decimal(38,0)")).alias("digest")
        ).select("space", F.lit(depth).alias("level"), "node", "n", "digest")
        tree, top = tree.unionByName(level), top // FAN
    return materialize(tree.withColumn("top", F.lit(depth)), "tree")


def build_tree(records: DataFrame, content: list[str] = ()) -> DataFrame:
    """All levels up to one root a space: space, level, node, n, digest, top."""
    return _grown(materialize(leaves(records, content), "leaves"))


def differing_leaves(now: DataFrame, saved: DataFrame | None) -> DataFrame:
    """(space, node) of the leaves in which the trees differ, found by descent."""
    depth = now.agg(F.max("top")).first()[0]
    if depth is None:
        return now.select("space", "node").limit(0)
    if saved is None:
        return now.filter("level = 0").select("space", "node")
    same_as = F.struct("n", "digest")
    open_nodes = None
    for level in range(depth, -1, -1):
        a = now.filter(F.col("level") == level).select("space", "node", same_as.alias("a"))
        b = saved.filter(F.col("level") == level).select("space", "node", same_as.alias("b"))
        if open_nodes is not None:
            parent = F.floor(F.col("node") / FAN).cast("long")
            above = open_nodes.select("space", F.col("node").alias("up"))
            a = _matched(a.withColumn("up", parent), above, ["space", "up"], "left_semi").drop("up")
        same = a.select("space", "node", F.col("a").alias("same"))
        open_nodes = _matched(same, b.select("space", "node", F.col("b").alias("same")), ["space", "node", "same"], "left_anti").select("space", "node")
    return open_nodes


def changed(records: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Records that are not among those taken: trees, descent, extraction.

    Both are distinct RECORD rows. With no record taken all come out.
    """
    if taken is None:
        return records.select(*RECORD)
    diff = differing_leaves(build_tree(records), build_tree(taken))
    place = lambda df: df.select(*RECORD, leaf_of(F.col("seq")).alias("node"))
    mine = _matched(place(records), diff, ["space", "node"], "left_semi")
    theirs = _matched(place(taken), diff, ["space", "node"], "left_semi")
    return _matched(mine.select(*RECORD), theirs, RECORD, "left_anti")


def coverage(runs: DataFrame, journal: DataFrame) -> DataFrame:
    """(space, node, pieces): for each leaf the ranges lo..hi that succeeded runs read, and until when.

    Of equal ranges the latest read counts, so a leaf has at most LEAF * (LEAF + 1) / 2
    pieces however often it was read. Runs that did not succeed, have no read_until, no
    from_seq or no known end take nothing.
    """
    by_tx = journal.select(F.col("tx_id").alias("last_tx_id"), F.col("seq").alias("tx_seq")).filter("tx_seq is not null").dropDuplicates(["last_tx_id"])
    good = runs.filter(F.lower(F.trim("status")) == "succeeded").join(by_tx, "last_tx_id", "left")
    good = good.select("space", F.col("from_seq").alias("lo"), F.coalesce("to_seq", "tx_seq").alias("hi"), F.col("read_until").alias("until")).dropna().filter("lo <= hi").distinct()
    # one row for each leaf that a run touches: bounded by leaves + runs
    pieces = good.select("space", "until", "lo", "hi", F.explode(F.sequence(leaf_of(F.col("lo")), leaf_of(F.col("hi")))).alias("node"))
    pieces = pieces.select("space", "node", "until", F.greatest("lo", F.col("node") * LEAF).alias("lo"), F.least("hi", F.col("node") * LEAF + LEAF - 1).alias("hi"))
    pieces = pieces.groupBy("space", "node", "lo", "hi").agg(F.max("until").alias("until"))
    return pieces.groupBy("space", "node").agg(F.collect_list(F.struct("lo", "hi", "until")).alias("pieces"))


def first_arrivals(feed: DataFrame) -> DataFrame:
    """Distinct changes with their first arrival, pre-aggregated on the map side."""
    return feed.select(*RECORD, "arrived_at").filter("element is not null and seq is not null").groupBy(*RECORD).agg(F.min("arrived_at").alias("arrived_at"))


def with_taken(changes: DataFrame, cover: DataFrame) -> DataFrame:
    """Add ``taken``: whether a succeeded run took the change.

    A change is taken if any of its arrivals was there when a run that covers it read,
    so its first arrival decides.
    """
    read = F.exists("pieces", lambda p: (p["lo"] <= F.col("seq")) & (F.col("seq") <= p["hi"]) & (F.col("arrived_at") <= p["until"]))
    met = changes.withColumn("node", leaf_of(F.col("seq"))).join(cover, ["space", "node"], "left")
    return met.withColumn("taken", F.coalesce(read, F.lit(False))).drop("pieces", "node")


class MerkleSync:
    """Runs over a growing table; each publishes its output and its tree together.

    :param content: columns besides the record's key whose change makes a record a changed one.
    """

    #: published outputs lie in so many folders by key range, of which a run reads those it needs
    ZONES = 64

    def __init__(self, spark: SparkSession, path: str, content: list[str] = ()):
        self.spark, self.path, self.content = spark, path.rstrip("/"), list(content)

    def _last(self) -> int:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        names = [s.getPath() for s in fs.listStatus(root)]
        return max([0, *(int(p.getName()[4:]) for p in names if p.getName().startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "PUBLISHED")))])

    def _zone(self, node: Column) -> Column:
        return F.pmod(F.xxhash64("space", F.floor(node / FAN)), F.lit(self.ZONES)).cast("int")

    def _done(self, diff: DataFrame, last: int) -> DataFrame:
        """What former runs gave out in some leaves: of the folders of their zones only."""
        zones = [r.zone for r in diff.select(self._zone(F.col("node")).alias("zone")).distinct().collect()]  # at most ZONES
        out = self.spark.read.parquet(f"{self.path}/output").filter((F.col("run") <= last) & F.col("zone").isin(zones))
        return _matched(out.withColumn("node", leaf_of(F.col("seq"))), diff, ["space", "node"], "left_semi")

    def pending(self, records: DataFrame, done: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(records not yet published, the tree to publish with them).

        :param records: distinct RECORD columns, the content columns and others.
        :param done: given the records of the differing leaves and these leaves (space,
            node), leaves those out that are done already; needed where the last tree was
            adopted and earlier outputs aren't here. Usually the published outputs tell.
        :param tree: the tree of the records, if it is there already.
        """
        last, tree = self._last(), build_tree(records, self.content) if tree is None else tree
        if not last:
            return records, tree
        diff = materialize(differing_leaves(tree, self.spark.read.parquet(f"{self.path}/run={last}/tree")), "differing")
        keyed = _matched(records.withColumn("node", leaf_of(F.col("seq"))), diff, ["space", "node"], "left_semi")
        if done is not None:
            return done(keyed.drop("node"), diff), tree
        return _matched(keyed, self._done(diff, last), [*RECORD, *self.content], "left_anti").drop("node"), tree

    def adopt(self, tree: DataFrame) -> int:
        """Take over the tree of what was done before the first run here."""
        return self.publish(None, tree)

    def publish(self, output: DataFrame | None, tree: DataFrame) -> int:
        """Write output and tree of the next run; only the marker makes them count."""
        run = self._last() + 1
        at = f"{self.path}/run={run}"
        if output is not None:
            output.withColumn("zone", self._zone(leaf_of(F.col("seq")))).write.mode("overwrite").partitionBy("zone").parquet(f"{self.path}/output/run={run}")
        tree.write.mode("overwrite").parquet(f"{at}/tree")
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{at}/PUBLISHED")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()
        return self._last()


def pending_after(sync: MerkleSync, changes: DataFrame, runs: DataFrame, journal: DataFrame) -> DataFrame:
    """The changes that no succeeded run of the ledger took.

    One pass over the changes makes the leaves of all and of those taken; the latter's
    tree is adopted as the saved one. The descent from the roots then finds the leaves
    that differ, and in these only the changes are looked at one by one.

    :param changes: RECORD columns and arrived_at, one row a change (``first_arrivals``).
    """
    cover = materialize(coverage(runs, journal), "cover")
    flagged = with_taken(changes, cover).withColumn("node", leaf_of(F.col("seq")))
    both = flagged.groupBy("space", "node").agg(F.count("*").alias("n"), _digest([]).alias("digest"), F.sum(F.col("taken").cast("long")).alias("n_taken"), _digest([], F.col("taken")).alias("digest_taken"))
    both = materialize(both, "leaves")
    level = lambda n, digest: both.select("space", F.lit(0).alias("level"), "node", F.col(n).alias("n"), F.col(digest).alias("digest"))
    now, saved = _grown(level("n", "digest")), _grown(level("n_taken", "digest_taken").filter("n > 0"))
    sync.adopt(saved)

    def open_only(found: DataFrame, diff: DataFrame) -> DataFrame:
        return with_taken(found, _matched(cover, diff, ["space", "node"], "left_semi")).filter("not taken")

    return sync.pending(changes, open_only, now)[0].select(*RECORD)
