"""Live queries and stream ingest over files that arrive."""

import pytest

from tallyhouse.engine import Engine
from tallyhouse.refusal import Refused
from tallyhouse.streaming.live import Watch, ingest, running_counts, watch

SCHEMA = "kind string, amount long, key string"


def test_ingest_leaves_out_what_is_there(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.sql("CREATE TABLE s (kind MUTEX, amount UINT(32), key MUTEX)")
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "k1"), ("a", 2, "k2"), ("b", 5, "k3")], SCHEMA).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest(e, "s", stream, str(tmp_path / "progress"), dedup="key", once=True).awaitTermination()
        spark.createDataFrame([("a", 2, "k2"), ("c", 7, "k4")], SCHEMA).write.mode("append").parquet(source)
    assert sorted(tuple(r) for r in e.sql("SELECT kind, sum(amount) FROM s GROUP BY kind").collect()) == [("a", 3), ("b", 5), ("c", 7)]


def test_watch_tells_changes_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.sql("CREATE TABLE s (kind MUTEX, amount UINT(32))")
    told = []
    own = Watch(e, "SELECT kind, count(*) AS n FROM s GROUP BY kind", lambda df, k: told.append([tuple(r) for r in df.collect()]))
    assert own.ask(0) and not own.ask(1)
    e.sql("INSERT INTO s (kind, amount) VALUES ('a', 1)")
    assert own.ask(2) and not own.ask(3)
    assert told == [[], [("a", 1)]]
    with pytest.raises(Refused):
        Watch(e, "TRUNCATE TABLE s", print)
    with pytest.raises(Refused):
        watch(e, "SELECT count(*) FROM s", None, print, interval=1)


def test_running_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS at, 'a' AS kind UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 03:00:00', 'b'").write.parquet(source)
    out = running_counts(spark.readStream.schema("at timestamp, kind string").parquet(source), "at", "kind")
    q = out.writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM counts").collect()] == [("a", 2)]


def test_queued_writes_are_acknowledged(spark, tmp_path):
    from tallyhouse.streaming.queue import WriteQueue

    e = Engine(spark, str(tmp_path / "store"))
    e.sql("CREATE TABLE s (kind MUTEX, amount UINT(8))")
    with WriteQueue(e, "s", ["kind", "amount"], within=0.3) as q:
        good = [q.put([["a", i]]) for i in range(5)]
        bad, more = q.put([["b", 1], ["b", 300]]), q.put([["c", 2], ["c", 3]])
        assert [x.result(60) for x in good] == [1] * 5 and more.result(60) == 2
        with pytest.raises(Refused, match="value_out_of_range"):
            bad.result(60)
        # what is acknowledged can be read
        assert sorted(tuple(r) for r in e.sql("SELECT kind, count(*) FROM s GROUP BY kind").collect()) == [("a", 5), ("c", 2)]
        last = q.put([["d", 1]])
    assert last.result(0) == 1
    with pytest.raises(ValueError):
        q.put([["e", 1]])
    assert len(e.store.table("s").parts) < 8


def test_a_settled_stream_is_read(spark, tmp_path):
    from tallyhouse.streaming.live import settled

    e = Engine(spark, str(tmp_path / "store"))
    e.sql("CREATE TABLE s (kind MUTEX, amount UINT(32), key MUTEX)")
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "k1")], SCHEMA).write.parquet(source)
    query = ingest(e, "s", spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "progress"), interval=50)
    try:
        spark.createDataFrame([("b", 2, "k2")], SCHEMA).write.mode("append").parquet(source)
        settled(query)
        assert sorted(r[0] for r in e.sql("SELECT kind FROM s").collect()) == ["a", "b"]
    finally:
        query.stop()
