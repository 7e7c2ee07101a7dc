"""What grows with the square of the input, with a task's rows, or with a key, in queries that the small tables don't strain."""

from pyspark.sql import functions as F

from tickloom.operators import arbitration as a
from tickloom.operators import boundaries as b
from tickloom.operators import dimensions as d
from tickloom.operators.books import recovered
from tickloom.operators.matching import queue_pairs
from tickloom.streaming.stateful import Kept, in_order


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_meet_counts_and_not_every_instrument_of_their_symbol(spark):
    many = spark.range(2000).selectExpr("'V' AS venue", "'S' AS symbol", "id % 4 AS channel", "id AS instrument_id")
    asked = many.selectExpr("concat('v:S#', channel, '.', instrument_id) AS id").union(spark.sql("SELECT 'v:S' UNION ALL SELECT 'v:T' UNION ALL SELECT 'S'"))
    found = d.resolve(d.parse_ids(asked), many)
    got = {r.id: (r.status, r.hits, r.channel, r.instrument_id) for r in found.collect()}
    assert got["v:S"] == (409, 2000, None, None) and got["v:T"] == (404, 0, None, None) and got["S"] == (400, 0, None, None)
    assert all(got[f"v:S#{i % 4}.{i}"] == (200, 1, i % 4, i) for i in range(2000))
    joins = [line for line in plan_of(found).splitlines() if "Join" in line]
    assert joins and all("instrument_id" in line for line in joins)


def test_no_join_deals_the_buckets_of_queues(spark):
    """A join may split a large partition, and a bucket that two tasks read has two beginnings."""
    rows = spark.createDataFrame([("s", 0, 0), ("s", 1, 5)], "sig string, publisher long, recv_us long")
    pairs = queue_pairs(rows, ["sig"], ["recv_us", "publisher"], 50)
    assert "Join" not in plan_of(pairs) and pairs.count() == 1


def test_a_table_s_steps_hold_no_rows_of_a_key(spark):
    """Rows of a key come as a sorted stream; states to begin with come before them."""
    rows = spark.range(50_000).selectExpr("id % 2 AS k", "50000 - id AS n")
    begun = spark.sql("SELECT 1L AS k, 100L AS total")
    kept = Kept("total long", lambda s: (s,), lambda r: r["total"])
    step = lambda state, row: ((state or 0) + 1, ((state or 0) + 1,))
    found = in_order(rows, ["k"], ["n"], step, kept, "nth long", first=begun)
    assert "TransformWithState" not in plan_of(found)
    last = {r.k: (r.lo, r.hi, r.same) for r in found.groupBy("k").agg(F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.count_if(F.col("nth") == F.ceil(F.col("n") / 2) + F.when(F.col("k") == 1, 100).otherwise(0)).alias("same")).collect()}
    assert last == {0: (1, 25_000, 25_000), 1: (101, 25_100, 25_000)}


def test_a_step_s_row_has_the_columns_that_it_reads(spark):
    """Others go through as they are, even a time that Python can't hold."""
    rows = spark.sql("SELECT id AS k, 1L AS n, TIMESTAMP_SECONDS(900000000000) AS far, array(named_struct('x', id)) AS wide FROM range(3)")
    kept = Kept("total long", lambda s: (s,), lambda r: r["total"])
    found = in_order(rows, ["k"], ["n"], lambda state, row: (0, (",".join(sorted(row)),)), kept, "names string", reads=["n"])
    assert sorted((r[0], r[1], r[2][0].x, r.names) for r in found.selectExpr("k", "unix_seconds(far)", "wide", "names").collect()) == [(i, 900_000_000_000, i, "k,n") for i in range(3)]


def test_stale_depths_know_who_led_their_tick(spark):
    one = "array(named_struct('price', 1.0D, 'size', 1.0D))"
    rows = spark.sql(f"SELECT 'S' AS symbol, publisher, source_us, recv_us, {one} AS bids, {one} AS asks FROM VALUES (1L, 5L, 10L), (2L, 9L, 20L), (3L, 5L, 30L), (4L, 2L, 40L), (4L, 99000000L, 50L), (5L, 99000000L, 60L) AS t(publisher, source_us, recv_us)")
    got = {r.recv_us: (r.verdict, r.leader, r.lead_us) for r in a.depth_verdicts(rows, ["recv_us"]).collect()}
    assert got == {10: ("open", 1, 0), 20: ("open", 2, 0), 30: ("stale", 1, 20), 40: ("stale", 4, 0), 50: ("future", None, None), 60: ("future", None, None)}


def test_the_windows_of_a_floor_share_an_exchange(spark):
    rows = spark.sql("SELECT 'S' AS symbol, 1L AS publisher, 1.0D AS price, id AS event_id, id AS tick, id AS recv_us FROM range(9)")
    dealt = [line for line in plan_of(a.floor_verdicts(rows)).splitlines() if "Exchange hashpartitioning" in line and "_tick" in line]
    assert len(dealt) == 1


def test_boundaries_are_dealt_once_and_not_once_a_power_of_two(spark):
    updates = spark.sql("SELECT id % 3 AS instrument_id, 'bid' AS side, id % 5 AS price, id % 2 AS qty, id AS t FROM range(60)")
    bounds = b.boundaries(updates, ["t"], F.col("t"))
    plan = plan_of(b.depth_at(bounds, b.lives(updates, bounds, ["t"], ["t"])))
    assert "explode(sequence(" not in plan and "explode([0," not in plan and plan.count("xxhash64") == 1


def test_a_recovered_market_s_deltas_are_not_dealt_by_market(spark):
    rows = spark.range(100).selectExpr("id % 2 AS instrument_id", "1 + floor(id / 2) AS seq", "'bid' AS side", "id % 7 AS price", "id AS qty", "id AS seq_place")
    begins = spark.sql("SELECT id AS snapshot_id, id AS instrument_id, 1L AS total, 10L AS last_seq FROM range(2)")
    levels = spark.sql("SELECT id AS snapshot_id, 'ask' AS side, 9L AS price, 5L AS size FROM range(2)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = recovered(begins, levels, rows)
        assert "Exchange hashpartitioning(instrument_id" in plan_of(found)
        assert not [line for line in plan_of(found).splitlines() if "SortMergeJoin [instrument_id#" in line and ", seq#" not in line and "_bucket" not in line]
        assert {(r.instrument_id, r.applied) for r in found.collect()} == {(0, 40), (1, 40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
