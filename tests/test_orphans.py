from __future__ import annotations

import random

from engram.operators.orphans import OrphanState

REF = "source_table string, source_field string, source_id long, target_id string, period string, alive string"
REC = "key string, alive boolean, at long"


def refs(spark, rows):
    return spark.createDataFrame([("t", "f", i, k, p, "clash") for i, k, p in rows], REF)


def test_waiting_resolved_and_reopened(spark, tmp_path):
    recs = lambda rows: spark.createDataFrame(rows, REC)
    found = lambda e=None: {(r.source_id, r.target_id) for r in s.orphans(e).collect()}
    s = OrphanState(spark, f"file://{tmp_path}/o", buckets=4)
    s.advance(refs(spark, [(1, "a", "m1"), (2, "b", "m1"), (2, "b", "m1"), (3, None, "m1"), (4, "c", None)]), recs([("a", True, 1), (None, True, 1)]))
    assert found() == {(2, "b"), (4, "c")}
    s.advance(refs(spark, [(5, "b", "m2"), (2, "b", "m1"), (6, "z", "m2")]), recs([("b", True, 2), ("a", False, 2), ("c", False, 2), ("c", True, 2)]))
    assert found() == {(1, "a"), (6, "z")} and found(1) == {(2, "b"), (4, "c")}
    # a null order counts as the earliest: the deletion of a stands; a null alive is a deletion
    s.advance(refs(spark, []), recs([("a", True, None), ("b", None, 3)]))
    assert found() == {(1, "a"), (6, "z"), (2, "b"), (5, "b")}
    assert {(r.period, r.orphans, r.refs, r.epoch) for r in s.snapshot().collect()} == {("m1", 2, 2, 3), (None, 0, 1, 3), ("m2", 2, 2, 3)}
    again = OrphanState(spark, f"file://{tmp_path}/o")
    assert again.epoch() == 3 and again.index.buckets == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = OrphanState(spark, f"file://{tmp_path}/o", buckets=16)
    s.advance(refs(spark, []), spark.createDataFrame([(f"k{i}", True, 1) for i in range(400)], REC))
    s.advance(refs(spark, [(1, "k7", "m")]), spark.createDataFrame([("k7", False, 2)], REC))
    assert len(list((tmp_path / "o/index/data/2").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "o/index/data/1").glob("bucket=*"))) == 16
    assert s.index.read().count() == 400 and [r.target_id for r in s.orphans().collect()] == ["k7"]


def test_empty(spark, tmp_path):
    s = OrphanState(spark, f"file://{tmp_path}/o")
    s.advance(refs(spark, []), spark.createDataFrame([], REC))
    assert s.orphans().collect() == [] and s.snapshot().collect() == []


def test_epochs_agree_with_one_pass(spark, tmp_path):
    rng = random.Random(1)
    reference = [(i, f"k{rng.choice([0] * 9 + list(range(1, 30)))}", "m") for i in range(200)]
    events = [(f"k{rng.randrange(30)}", rng.random() < 0.6, t) for t in range(120)]
    state, last = OrphanState(spark, f"file://{tmp_path}/o", buckets=8), {}
    for part in range(3):
        state.advance(refs(spark, reference[part::3]), spark.createDataFrame(events[part * 40 : part * 40 + 40], REC))
    for k, alive, _ in events:
        last[k] = alive
    assert {r.source_id for r in state.orphans().collect()} == {i for i, k, _ in reference if not last.get(k)}
