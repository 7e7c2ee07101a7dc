"""Pairs by waiting queues against one pass over all copies."""

import random
import time

import pyarrow as pa
import pytest

from tickloom.operators import matching
from tickloom.operators.arbitration import race_pairs
from tickloom.operators.matching import Queue, queue_pairs, unpaired
from tickloom.plans import races
from tickloom.sources.tables import mirrored

SCHEMA = "sig string, id long, publisher long, recv_us long, first string"


def model(rows, window, most=8):
    queues, out = {}, []
    for sig, _, path, at, *_ in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        waiting = [x for x in queues.get(sig, []) if at - x[1] <= window]
        peer = next((x for x in waiting if x[0] != path), None)
        if peer:
            waiting.remove(peer)
            out.append((sig, peer[0], path, at - peer[1], peer[1]))
        else:
            waiting = [*waiting, (path, at)][-most:]
        queues[sig] = waiting
    return sorted(out, key=repr)


def found(spark, rows, window, **more):
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in queue_pairs(table, ["sig"], ["recv_us", "publisher", "id"], window, **more).collect()], key=repr)


@pytest.mark.parametrize(("seed", "window", "width", "most"), [(0, 50, 50, 8), (1, 7, 20, 8), (2, 500, 1, 8), (3, 60, 60, 2), (4, 20, 10**9, 8), (5, 0, 5, 8)])
def test_equals_one_pass(spark, seed, window, width, most):
    some, rows = random.Random(seed), []
    for i in range(600):
        at = some.randint(0, 6000)
        for path in range(3):
            if some.random() < (0.9, 0.5, 0.3)[path]:
                rows.append((some.choice(["a", "a", "a", "b", None]), i, path, at + some.randint(0, 30)))
    assert found(spark, rows, window, width_us=width, most=most) == model(rows, window, most)


def test_a_lost_copy_does_not_shift_the_pairs_that_follow(spark):
    rows = [("s", 0, 0, 0), ("s", 1, 0, 10_000_000), ("s", 1, 1, 10_500_000)]
    assert found(spark, rows, 5_000_000) == [("s", 0, 1, 500_000, 10_000_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert [r.delta_us for r in race_pairs(table, ["sig"], ["recv_us", "id"], (0, 1), 5_000_000).collect()] == [500_000]


def test_pairs_of_a_queue():
    q = Queue()
    assert [q.offer(*x, 10_000, 8) for x in ((1, 1000), (1, 2000), (2, 3000), (2, 4000))] == [None, None, (1, 1000), (1, 2000)]
    assert q.offer(1, 5000, 10_000, 8) is None and q.offer(2, 99_000, 10_000, 8) is None and q.held == [99_000]


def test_counts_of_what_was_never_paired(spark):
    rows = [("s", 0, 0, 0), ("s", 1, 0, 100), ("s", 1, 1, 105), ("t", 2, 1, 200), ("t", 3, 2, 1000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    pairs = queue_pairs(table, ["sig"], ["recv_us", "publisher", "id"], 50)
    assert sorted(tuple(r) for r in unpaired(table, pairs, 50, "recv_us").collect()) == [(0, 2, 1), (1, 2, 1), (2, 1, 0)]


def test_odd_rows(spark):
    assert found(spark, [], 5) == [] and found(spark, [("s", 1, None, 1), ("s", 1, 1, None), ("s", 1, 0, 1)], 5) == []


def test_signatures_are_compared_by_spark_and_never_read_by_python(spark):
    """NaN and the two zeros are values like any other; a time that Python can't hold goes through as it is."""
    rows = spark.sql("SELECT CAST(p AS DOUBLE) AS price, CAST(t AS TIMESTAMP) AS day, publisher, recv_us FROM VALUES ('NaN', 0, 0L, 10L), ('NaN', 0, 1L, 15L), ('-0.0', 0, 0L, 20L), ('0.0', 0, 1L, 26L), ('1.0', 900000000000, 0L, 30L), ('1.0', 900000000000, 1L, 37L) AS v(p, t, publisher, recv_us)")
    for width in (1, 3_600_000_000):
        pairs = queue_pairs(rows, ["price", "day"], ["recv_us", "publisher"], 50, width_us=width)
        found = pairs.selectExpr("isnan(price)", "unix_seconds(day)", "first", "second", "delta_us", "first_us").collect()
        assert sorted(tuple(r) for r in found) == [(False, 0, 0, 1, 6, 20), (False, 900_000_000_000, 0, 1, 7, 30), (True, 0, 0, 1, 5, 10)]


def test_queues_that_become_equal_go_on_as_one(monkeypatch):
    """A bucket that may begin with 25 queues doesn't cost 25 times its rows."""
    calls, offer, some = [], Queue.offer, random.Random(0)
    monkeypatch.setattr(Queue, "offer", lambda self, *args: (calls.append(1), offer(self, *args))[1])
    rows = [(matching.BEFORE, i % 3, i) for i in range(24)] + [(matching.OWN, some.randint(0, 2), 24 + i) for i in range(5000)]
    kinds, paths, times = zip(*rows, strict=True)
    batch = pa.record_batch({"_k0": ["s"] * len(rows), "_in": [1] * len(rows), "_ends": [False] * (len(rows) - 1) + [True], "_kind": kinds, "_path": paths, "_at": times})
    # cut in the middle, as batches are
    (table,) = [t for b in matching._tables(iter([batch.slice(0, 1000), batch.slice(1000)]), ["_k0"], 10**6, 8) for t in b.column("_table").to_pylist()]
    assert len(table) == 25 * 4 and len(calls) < 2 * 5000
    for path, n in ((0, 0), (1, 3), (2, 8)):
        queue = Queue(path, [at for kind, p, at in rows if kind == matching.BEFORE and p == path][-n:] if n else [])
        for kind, p, at in rows:
            if kind == matching.OWN:
                offer(queue, p, at, 10**6, 8)
        assert any(tuple(table[k : k + 4]) == (path if n else 0, n, *queue.known_by()) for k in range(0, 100, 4))


@pytest.mark.parametrize(("seed", "window", "width", "paths"), [(0, 400, 1, 3), (1, 2500, 1, 2), (2, 90, 200, 5), (3, 0, 1, 3), (4, 700, 10**9, 3)])
def test_no_copy_gives_way_if_all_may_wait(spark, seed, window, width, paths):
    some, rows = random.Random(seed), []
    for i in range(900):
        # a path is often alone for a while, so that many more than eight wait
        path = some.randrange(paths) if some.random() < 0.3 else i // 40 % paths
        rows.append((some.choice(["a", "a", "a", "b"]), i, path, i * 5 + some.randint(0, 30)))
    want = model(rows, window, 10**6)
    assert found(spark, rows, window, width_us=width, most=None) == want
    assert window < 400 or len(want) > len(model(rows, window, 8))


def test_twenty_copies_that_wait_all_pair(spark):
    rows = [("s", i, 0, i) for i in range(20)] + [("s", i, 1, 100 + i) for i in range(20)]
    assert found(spark, rows, 200, most=None) == [("s", 0, 1, 100, i) for i in sorted(range(20), key=repr)]


@pytest.mark.parametrize("most", [None, 3])
def test_a_copy_costs_no_more_when_many_wait(most):
    """A bucket that may begin with 9,001 queues: all of them together, each as it goes alone."""
    some = random.Random(1)
    before = {p: list(range(p, 9000, 3)) for p in range(3)}
    own = [(some.choice((0, 1, 1, 2)), 9000 + i) for i in range(9000)]
    queues = matching.Queues(before, 8000, most)
    starts = len(queues.starts)
    began = time.process_time()
    for copy in own:
        queues.offer(*copy)
    assert time.process_time() - began < 3  # 81 million steps take ten times as long
    table = queues.table()
    assert starts == (9001 if most is None else 10) and len(table) == 4 * starts
    for k in some.sample(range(starts), 9):
        path, n, *after = table[4 * k : 4 * k + 4]
        queue = Queue(path, before[path][-n:] if n else [])
        for copy in own:
            queue.offer(*copy, 8000, most)
        assert after == list(queue.known_by())


def test_race_pairs_of_all_lets_all_copies_wait(spark, tmp_path):
    """A hundred trades of one symbol and size, three paths' copies minutes apart: eight waiting copies were all that could pair."""
    spark.sql("SELECT id AS event_id, TIMESTAMP_SECONDS(1000 + id) AS ts, id AS user_id, 'A' AS event_type, 1.0D AS value FROM range(0, 700, 7)").write.parquet(f"{tmp_path}/events.parquet")
    copies = [("A", r.event_id, r.publisher, r.recv_us) for r in mirrored(spark, str(tmp_path)).collect()]
    want = model(copies, races.WINDOW_US, 10**6)
    got = sorted([("A", *r) for r in races.race_pairs_of_all(spark, str(tmp_path)).drop("symbol", "size").collect()], key=repr)
    assert got == want and len(want) > len(model(copies, races.WINDOW_US))
