from __future__ import annotations

from sievework.sources.sinks import Versioned
from sievework.streaming import state_stream as st


def test_upsert_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", "2027-02-01", "", 1), ("b", "2026-01-01", "", 2)], "uid string, deadline string, posted_date string, ord int")
    rows.coalesce(1).write.parquet(str(src))
    schema = "uid string, deadline string, posted_date string, first_seen string, last_seen string, notified boolean"
    table = Versioned(spark, f"file://{tmp_path}/state")
    sent = []
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    st.run_upsert(stream, table, schema, "uid", "ord", ["deadline", "posted_date"], lambda n: "2027-01-10T00:00:00", str(tmp_path / "cp"), lambda df: sent.extend(r["uid"] for r in df.collect())).awaitTermination()
    assert sent == ["a"]
    assert [r["uid"] for r in table.read(schema).collect()] == ["a"]


def test_windowed(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp'2027-01-01 00:01:00' ts, 'a' k union all select timestamp'2027-01-01 00:02:00', 'a' union all select timestamp'2027-01-01 01:02:00', 'a'").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(src))
    q = st.windowed_counts(stream, ["k"], "ts", "10 minutes", "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    first = st.first_seen(stream, "k", "ts", "1 hour").writeStream.format("memory").queryName("f").start()
    first.processAllAvailable()
    first.stop()
    assert spark.table("f").count() == 1
