"""Stored tables and results: batches in any order, again and late, against one batch and against plain folds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import usage
from lectern.operators.results import StoredResults
from lectern.operators.snapshots import CLIENTS, FEEDBACK, StoredTable, client_changes, feedback_changes, live_feedback

START = datetime(2026, 1, 1)
FIELDS = "id bigint, client bigint, ts timestamp, day date, scan bigint, vote string, reason string, comment string, photo string"


def touches(spark, n=200):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2, 3, 40, 41]), START + timedelta(minutes=rnd.randrange(900)), rnd.choice([None, "en", "es"]), i % 10) for i in range(n)]
    return spark.createDataFrame(rows, "client bigint, ts timestamp, lang string, b int")


def table(spark, path, fold, changes, parts=4):
    return StoredTable(spark, str(path), fold, changes.schema, parts)


def test_ten_batches_give_what_one_gives(spark, tmp_path):
    t = touches(spark)
    stored = table(spark, tmp_path / "t", CLIENTS, client_changes(t))
    assert stored.read().count() == 0 and stored.version() == 0
    for b in random.Random(1).sample(range(10), 10):
        assert stored.apply(client_changes(t.where(F.col("b") == b)), f"b{b}")
    want = sorted(map(tuple, usage.upsert_clients(t).collect()))
    assert sorted(map(tuple, stored.read().collect())) == want
    # The same batch by its name, and the same rows by another name.
    assert not stored.apply(client_changes(t.where("b = 3")), "b3") and stored.version() == 10
    assert stored.apply(client_changes(t.where("b = 3")), "again")
    assert sorted(map(tuple, stored.read().collect())) == want


def test_a_batch_writes_only_the_parts_it_touches(spark, tmp_path):
    t = touches(spark)
    stored = table(spark, tmp_path / "t", CLIENTS, client_changes(t), parts=16)
    stored.apply(client_changes(t), "all")
    before = sorted(map(tuple, stored.read().collect()))
    one = spark.createDataFrame([(3, START + timedelta(days=9), "fr")], "client bigint, ts timestamp, lang string")
    stored.apply(client_changes(one), "one")
    assert stored.commits().where("version = 2").count() == 1 < stored.commits().where("version = 1").count()
    assert {r.client: r.lang for r in stored.read().collect()}[3] == "fr"
    assert sorted(map(tuple, stored.read(1).collect())) == before
    # An empty batch is remembered; forgetting leaves what the version reads.
    assert stored.apply(client_changes(one.limit(0)), "none") and not stored.apply(client_changes(one), "none")
    now = sorted(map(tuple, stored.read().collect()))
    assert stored.forget(stored.version()) >= 1
    assert sorted(map(tuple, stored.read().collect())) == now


def test_a_batch_that_fails_changes_nothing(spark, tmp_path):
    t = touches(spark)
    stored = table(spark, tmp_path / "t", CLIENTS, client_changes(t))
    stored.apply(client_changes(t.where("b < 5")), "first")
    before = sorted(map(tuple, stored.read().collect()))
    bad = t.where("b = 5").withColumn("lang", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).cast("string"))
    try:
        stored.apply(client_changes(bad), "bad")
        raise AssertionError("a failing batch went through")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert sorted(map(tuple, stored.read().collect())) == before and stored.version() == 1
    assert stored.apply(client_changes(t.where("b >= 5")), "bad")
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, usage.upsert_clients(t).collect()))


def test_feedback_written_edited_and_deleted_in_any_order(spark, tmp_path):
    written = spark.createDataFrame([(i, i % 3 if i % 4 else None, START, START.date(), i - 1, "up", None, None, f"p{i}") for i in range(12)], FIELDS)
    at = lambda h: START + timedelta(hours=h)
    edits = spark.createDataFrame(
        [(1, 1, at(1), "slow", "one", None), (1, 1, at(2), None, "two", None), (1, 2, at(3), "other", "not mine", None), (4, None, at(1), "slow", None, "q"), (99, 1, at(1), "slow", None, None)],
        "id bigint, client bigint, ts timestamp, reason string, comment string, photo string",
    )
    deletes = spark.createDataFrame([(5, at(4)), (98, at(4))], "id bigint, ts timestamp")
    parts = [feedback_changes(deletes=deletes), feedback_changes(edits=edits.where("comment is null")), feedback_changes(edits=edits.where("comment is not null")), feedback_changes(written)]
    merged = usage.merge_feedback(written, edits).where("id <> 5")
    cols = ["id", "client", "ts", "day", "scan", "vote", "reason", "comment", "photo"]
    want = sorted(map(repr, map(tuple, merged.select(*cols).collect())))
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        stored = table(spark, tmp_path / f"t{order[0]}", FEEDBACK, parts[0])
        for n in order:
            stored.apply(parts[n], str(n))
        live, gone = live_feedback(stored)
        assert sorted(map(repr, map(tuple, live.select(*cols).collect()))) == want
        assert [tuple(r) for r in gone.collect()] == [(5, "p5")]


def test_a_stream_folds_each_batch_once(spark, tmp_path):
    t = touches(spark)
    for b in range(3):
        t.where(F.col("b") % 3 == b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stored = table(spark, tmp_path / "t", CLIENTS, client_changes(t))
    for state in ("s", "s", "lost"):  # go on where it stopped; then again from the start, as after a lost checkpoint
        log = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        q = client_changes(log).writeStream.foreachBatch(stored.sink("clients")).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert stored.version() == 3
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, usage.upsert_clients(t).collect()))


def test_second_run_computes_only_new_contents(spark, tmp_path):
    rows = [(i, None if i == 7 else "text " * (i % 5 + 1)) for i in range(20)]
    docs = spark.createDataFrame(rows, "id int, body string")
    results = StoredResults(spark, str(tmp_path), spark.createDataFrame([], "n int").schema, 8)
    compute = lambda d: d.select("key", F.length("body").alias("n"))
    out, n = results.run(docs.where("id % 5 < 3"), "body", "v1", compute)
    assert n == 3 and out.count() == 12
    out, n = results.run(docs, "body", "v1", compute)
    assert n == 2 and {r.id: r.n for r in out.collect()} == {i: len(b) if b else None for i, b in rows}
    assert results.run(docs, "body", "v1", compute)[1] == 0 and results.run(docs, "body", "v2", compute)[1] == 5
    assert sorted(r.computed for r in results.runs().collect()) == [0, 2, 3, 5]
    plan = results.read([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:200]
