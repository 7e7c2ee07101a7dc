"""Recovery of books: scenarios, and the operator against the machine run over all messages at once."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.streaming.recovery import OrderRecovery, Recovery, recovered_sessions, recovery

SCHEMA = "publisher long, instrument_id long, n long, kind string, seq long, mktdata_seq long, snapshot_id long, anchor_seq long, total long, last_seq long, part string"


def ready(machine=Recovery, last=10, anchor=100):
    book = machine()
    assert book.begin((1, anchor, 1, last)) == "opened" and book.part(1, "bid 5") == "taken" and book.end(1, anchor) == "installed"
    return book


def test_levels_are_judged_by_their_last_delta_orders_by_their_anchor():
    book = ready()
    assert book.begin((2, 900, 1, 10)) == "declined"  # a newer anchor alone brings nothing
    assert book.begin((2, 50, 1, 11)) == "opened"
    book = ready(OrderRecovery)
    assert book.begin((2, 100, 1, 99)) == "declined" and book.begin((2, 101, 1, 1)) == "opened"


def test_gap_and_what_waits():
    book = ready()
    assert [book.delta(s, 100 + s) for s in (11, 11, 12, 14, 15)] == ["applied", "duplicate", "applied", "gap", "buffered"] and book.status == "gap"
    assert book.begin((2, 113, 0, 13)) == "opened" and book.end(2, 113) == "installed" and (book.status, book.applied) == ("ready", 15)


def test_replay_stops_at_a_gap():
    book = ready()
    book.delta(20, 120), book.delta(22, 122), book.delta(23, 123)
    book.begin((2, 119, 0, 19)), book.end(2, 119)
    assert (book.status, book.applied, book.waiting) == ("gap", 20, [(122, 22), (123, 23)])
    book = ready(OrderRecovery)
    book.delta(20, 120), book.delta(22, 122), book.delta(23, 123)
    book.begin((2, 119, 0, 19)), book.end(2, 119)
    assert (book.status, book.applied, book.waiting) == ("recovering", 20, [(122, 22)])


def test_incomplete_groups_and_repeated_datagrams():
    book = ready()
    assert book.begin((2, 200, 2, 12)) == "opened" and book.part(2, "bid 5") == "taken"
    assert book.begin((2, 200, 2, 12)) == "repeated" and book.part(2, "bid 5") == "repeated" and book.part(3, "bid 6") == "orphan"
    assert book.end(2, 200) == "incomplete" and book.status == "awaiting" and book.end(2, 200) == "declined"
    book = ready(OrderRecovery)
    book.begin((2, 200, 2, 12)), book.part(2, "7"), book.part(2, "7")
    assert book.end(2, 200) == "installed"  # messages count


def test_reset_asks_for_a_newer_anchor_and_a_session_leaves_nothing():
    book = ready()
    book.delta(20, 120), book.delta(21, 500)
    assert book.reset(400) == "reset" and book.waiting == [(500, 21)] and book.begin((3, 399, 0, 30)) == "declined" and book.begin((3, 400, 0, 20)) == "opened"
    assert book.end(3, 400) == "installed" and book.applied == 21
    one = ready()
    one.take({"kind": "session_end"})
    assert one.pack() == Recovery().pack()


def messages(seed, count=500):
    some, out = random.Random(seed), []
    for publisher in range(2):
        for market in range(2):
            seq = snapshot = 0
            for n in range(count):
                kind = some.choices(["delta", "begin", "part", "end", "reset", "session_end"], [60, 6, 25, 6, 1, 1])[0]
                seq += kind == "delta" and some.random() < 0.97
                snapshot += kind == "begin"
                lost = kind == "delta" and some.random() < 0.03
                if not lost:
                    out.append((publisher, market, n, kind, seq, n, snapshot - (some.random() < 0.05), some.choice([n, n - 5, 1]), some.randint(0, 3), max(0, seq - some.randint(0, 3)), f"bid {some.randint(0, 9)}"))
    # an end names the anchor of its begin
    fixed, anchors = [], {}
    for r in out:
        if r[3] == "begin":
            anchors[r[0], r[1]] = r[7]
        fixed.append((*r[:7], anchors.get((r[0], r[1]), 0), *r[8:]) if r[3] == "end" else r)
    return fixed


def model(rows, machine):
    books, out = {}, {}
    for r in sorted(rows, key=lambda r: r[:3]):
        book = books.setdefault(r[:2], machine())
        was = book.status
        outcome = book.take(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)))
        out[r[:3]] = (outcome, was, book.status, book.applied)
    return out


@pytest.mark.parametrize("machine", [Recovery, OrderRecovery])
def test_a_table_by_sessions_equals_one_pass(spark, machine):
    rows = messages(1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.publisher, r.instrument_id, r.n): (r.outcome, r.was, r.status, r.applied) for r in recovered_sessions(table, ["publisher", "instrument_id"], ["n"], F.floor(F.col("n") / 50), machine).collect()}
    want = model(rows, machine)
    assert got == want and {o for o, *_ in want.values()} >= {"applied", "buffered", "duplicate", "gap", "installed", "incomplete", "declined"}


def test_a_stream_equals_one_pass(spark, tmp_path):
    rows = sorted(messages(2, 150), key=lambda r: r[2])
    for i in range(3):
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a cut may split messages of one n of two books: order within a book is what counts
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = recovery(stream, ["publisher", "instrument_id"], ["n"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = {(r.publisher, r.instrument_id, r.n): (r.outcome, r.was, r.status, r.applied) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == model(rows, Recovery)
