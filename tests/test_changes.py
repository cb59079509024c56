from __future__ import annotations

import random
import shutil

from pyspark.sql import functions as F

from engram.operators import merkle
from engram.streaming.change_apply import ChangeTable, current_rows, reduce_changes

SCHEMA = "element string, seq long, op string, row string, key string"


def replay(rows):
    """Apply the distinct changes in order."""
    live = {}
    for e, q, op, row, _ in sorted({(e, q, (op or "").strip().lower(), row, k) for e, q, op, row, k in rows if e is not None and q is not None}, key=lambda x: (x[0], x[1])):
        if op == "create" or e in live and op != "purge":
            live[e] = (q, row)
        elif op == "purge":
            live.pop(e, None)
    return {(e, q, row) for e, (q, row) in live.items()}


def feed(n=400, seed=2):
    rng = random.Random(seed)
    made = {}
    for _ in range(n):
        e, q = f"e{rng.choice([0] * 5 + list(range(12)))}", rng.randrange(60)
        made[e, q] = (e, q, rng.choice(["update", " Create ", "purge", "merge", "CREATE", "PURGE\t", "update", None]), f"r{e}{q}", "clash")
    rows = list(made.values()) + [rng.choice(list(made.values())) for _ in range(60)]
    rng.shuffle(rows)
    return rows


def test_out_of_order_and_repeated_changes(spark):
    rows = feed() + [(None, 1, "create", "x", ""), ("e1", None, "create", "x", "")]
    state = reduce_changes(spark.createDataFrame(rows, SCHEMA), "element", "seq", "op", "row")
    assert {tuple(r) for r in current_rows(state).collect()} == replay(rows)


def test_empty(spark):
    assert current_rows(reduce_changes(spark.createDataFrame([], SCHEMA), "element", "seq", "op")).collect() == []


def test_batches_replayed_batches_and_stream_agree(spark, tmp_path):
    rows = feed(300, 5)
    table = ChangeTable(spark, f"file://{tmp_path}/t", "element", "seq", "op", "row")
    assert table.current() is None
    for i in range(3):
        for _ in range(2 if i == 1 else 1):  # a batch that is applied again
            table.apply(spark.createDataFrame(rows[i::3], SCHEMA), i)
    assert {tuple(r) for r in table.current().collect()} == replay(rows)
    source = tmp_path / "in"
    for i in range(2):
        spark.createDataFrame(rows[i::2], SCHEMA).coalesce(1).write.parquet(f"file://{source}", mode="append")
    streamed = ChangeTable(spark, f"file://{tmp_path}/s", "element", "seq", "op", "row")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    streamed.follow(stream, f"file://{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in streamed.current().collect()} == replay(rows)
    shutil.rmtree(source)


def test_changed_records_by_descent(spark):
    rng = random.Random(4)
    rows = sorted({("s" if rng.random() < 0.8 else "t", rng.randrange(5000), f"e{rng.randrange(40)}") for _ in range(900)})
    for taken in (rows, rows[:-1], rows[::3], [], rows[100:]):
        make = lambda x: spark.createDataFrame(x, "space string, seq long, element string")
        found = {tuple(r) for r in merkle.changed(make(rows), make(taken)).collect()}
        assert found == set(rows) - set(taken)
    assert merkle.changed(make([]), make(rows)).collect() == []
    assert merkle.changed(make(rows), None).count() == len(rows)


def test_only_differing_leaves_are_opened(spark):
    rows = [("s", i, "e") for i in range(6400)]
    make = lambda x: merkle.build_tree(spark.createDataFrame(x, "space string, seq long, element string"))
    diff = {(r.space, r.node) for r in merkle.differing_leaves(make(rows), make([r for r in rows if r[1] != 700])).collect()}
    assert diff == {("s", 700 // merkle.LEAF)}


def test_ledger_of_runs(spark, tmp_path):
    feed_ = spark.createDataFrame([("s", 1, "a", 10), ("s", 2, "a", 30), ("s", 2, "a", 99), ("s", 3, "b", 10), ("s", 4, "b", 10), ("t", 1, "c", 10), (None, 1, "d", 1)], "space string, seq long, element string, arrived_at long")
    runs = spark.createDataFrame([("s", 1, 2, None, 20, "succeeded"), ("s", 1, 9, None, 99, "failed"), ("s", 3, None, "tx3", 20, " Succeeded"), ("t", 1, None, None, 99, "succeeded"), ("s", 4, 4, None, None, "succeeded"), ("s", 4, 2, None, 99, "succeeded"), ("s", 1, 4, None, 99, None)], "space string, from_seq long, to_seq long, last_tx_id string, read_until long, status string")
    journal = spark.createDataFrame([("tx3", 3), ("tx3", 3), ("tx9", None)], "tx_id string, seq long")
    first = merkle.first_arrivals(feed_)
    left = merkle.pending_after(merkle.MerkleSync(spark, f"file://{tmp_path}/m"), first, runs, journal)
    assert {(r.element, r.seq) for r in left.collect()} == {("a", 2), ("b", 4), ("c", 1), ("d", 1)}
    none = merkle.pending_after(merkle.MerkleSync(spark, f"file://{tmp_path}/n"), first, runs.limit(0), journal)
    assert none.count() == 6
    assert merkle.pending_after(merkle.MerkleSync(spark, f"file://{tmp_path}/e"), first.limit(0), runs, journal).collect() == []


def test_ledger_against_every_run(spark, tmp_path):
    rng = random.Random(7)
    feed_ = [(rng.choice("st"), rng.randrange(700), f"e{rng.randrange(9)}", rng.randrange(100)) for _ in range(1500)]
    runs = [(rng.choice("st"), lo := rng.randrange(700), lo + rng.randrange(200), None, rng.randrange(100), rng.choice(["succeeded", "failed"])) for _ in range(14)]
    first = merkle.first_arrivals(spark.createDataFrame(feed_, "space string, seq long, element string, arrived_at long"))
    runs_ = spark.createDataFrame(runs, "space string, from_seq long, to_seq long, last_tx_id string, read_until long, status string")
    left = merkle.pending_after(merkle.MerkleSync(spark, f"file://{tmp_path}/m"), first, runs_, spark.createDataFrame([], "tx_id string, seq long"))
    taken = {(s, q, e) for s, q, e, at in feed_ for r in runs if r[5] == "succeeded" and r[0] == s and r[1] <= q <= r[2] and at <= r[4]}
    assert {tuple(r) for r in left.collect()} == {(s, q, e) for s, q, e, _ in feed_} - taken


def test_records_whose_content_changed(spark, tmp_path):
    sync = merkle.MerkleSync(spark, f"file://{tmp_path}/sync", ["row"])
    make = lambda changed: spark.range(900).select(F.lit("s").alias("space"), F.col("id").alias("seq"), F.lit("e").alias("element"), F.when(F.col("id").isin(changed), "new").otherwise("old").alias("row"))
    sync.publish(*sync.pending(make([])))
    assert {r.seq for r in sync.pending(make([5, 700]))[0].collect()} == {5, 700}


def test_runs_publish_output_and_tree_together(spark, tmp_path):
    sync = merkle.MerkleSync(spark, f"file://{tmp_path}/sync")
    make = lambda n: spark.range(n).select(F.lit("s").alias("space"), F.col("id").alias("seq"), F.lit("e").alias("element"))
    output, tree = sync.pending(make(1000))
    assert output.count() == 1000 and sync.publish(output, tree) == 1
    output, tree = sync.pending(make(1100))
    output.write.parquet(f"file://{tmp_path}/sync/output/run=2/zone=0")  # a run that fails before its marker
    output, tree = sync.pending(make(1100))
    assert {r.seq for r in output.collect()} == set(range(1000, 1100)) and sync.publish(output, tree) == 2
    assert sync.pending(make(1100))[0].count() == 0


def test_changes_without_a_space_come_out_once(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "space string, seq long, element string")
    rows = [(None, i, "e") for i in range(0, 3000, 30)] + [("s", i, "e") for i in range(0, 3000, 30)]
    for taken in ([], rows[100:], rows[:40], rows):
        found = [tuple(r) for r in merkle.changed(make(rows), make(taken)).collect()]
        assert len(found) == len(set(found)) and set(found) == set(rows) - set(taken)
    sync = merkle.MerkleSync(spark, f"file://{tmp_path}/null")
    sync.publish(*sync.pending(make(rows[:40])))
    assert {tuple(r) for r in sync.pending(make(rows))[0].collect()} == set(rows[40:])
