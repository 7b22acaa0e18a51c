"""Lazy propagation as a stream: batches by number and by age, repeated and late changes, retries, the log."""

import datetime as dt

from quern.streaming import propagation as pr

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def feed(spark, path, rows):
    spark.createDataFrame(rows, pr.CHANGES).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(pr.CHANGES).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, tmp_path, propagator, **rules):
    propagator.start(stream(spark, str(tmp_path / "in")), str(tmp_path / "ckpt"), **rules).awaitTermination()


def test_by_number_and_age(spark, tmp_path):
    log, seen = pr.ChangeLog(spark, str(tmp_path / "log")), []
    take = pr.Propagator(log, lambda batch, i: seen.extend((r["key"], r["reason"], r["change_id"]) for r in batch.orderBy("key", "reason", "at", "change_id").collect()))
    feed(spark, str(tmp_path / "in"), [("a", f"a{i:02}", "node", f"n{i}", at(i)) for i in range(7)] + [("b", "b1", "edge", "e", at(1)), ("b", None, "edge", "e", at(1)), (None, "x", "edge", "e", at(1)), ("b", "b0", "edge", "e", None)])
    run(spark, tmp_path, take, most=5, delay=300, late="60 seconds")
    assert seen == [("a", "full", f"a{i:02}") for i in range(5)]  # five make a batch, two wait, b waits
    feed(spark, str(tmp_path / "in"), [("a", "a05", "node", "n5", at(5)), ("a", "a07", "node", "n7", at(50))])  # one comes again
    feed(spark, str(tmp_path / "in"), [("c", "c1", "node", "n", at(2000))])  # time goes on
    feed(spark, str(tmp_path / "in"), [("c", "c0", "node", "n", at(1999))])
    feed(spark, str(tmp_path / "in"), [("a", "late", "node", "n", at(100)), ("c", "c2", "node", "n", at(2001))])  # later than the watermark
    feed(spark, str(tmp_path / "in"), [("c", "c3", "node", "n", at(2002))])
    run(spark, tmp_path, take, most=5, delay=300, late="60 seconds")
    assert sorted(seen[5:]) == [("a", "old", "a05"), ("a", "old", "a06"), ("a", "old", "a07"), ("b", "old", "b1")]
    rows = log.read().collect()
    assert {(r["change_id"], r["status"], r["tries"]) for r in rows} == {(c, "propagated", 1) for *_, c in seen}
    assert {r["change_id"] for r in log.read(since=at(4)).collect()} == {"a04", "a05", "a06", "a07"}
    first = min(r["batch"] for r in rows)
    assert {r["change_id"] for r in log.rollback(first).collect()} == {"a05", "a06", "a07", "b1"} and log.read().count() == 5


def test_retries(spark, tmp_path):
    tries = []

    def flaky(batch, i):
        tries.append(i)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    feed(spark, str(tmp_path / "in"), [("a", f"c{i}", "node", "n", at(i)) for i in range(4)])
    log = pr.ChangeLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    run(spark, tmp_path, pr.Propagator(log, flaky), most=4)
    assert [(r["status"], r["tries"]) for r in log.read().select("status", "tries").distinct().collect()] == [("propagated", 3)]
    feed(spark, str(tmp_path / "in"), [("a", f"d{i}", "node", "n", at(i + 10)) for i in range(4)])

    def never(batch, i):
        raise RuntimeError("never")

    run(spark, tmp_path, pr.Propagator(log, never, retries=2), most=4)
    assert {(r["change_id"], r["tries"]) for r in log.read(status="failed").collect()} == {(f"d{i}", 3) for i in range(4)} and log.read(status="propagated").count() == 4
