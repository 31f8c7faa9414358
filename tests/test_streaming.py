"""Streams run to their end, twice."""

from pyspark.sql import functions as F

from pricelake.streaming.ingest import append_new, current, deduplicated, once, windowed_counts

SCHEMA = "partner_id string, code string, effective_date date, price_resident double, seq string"


def test_late_lists_stay_inactive(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, "partner_id string, code string, d string, price_resident double, seq string").select("partner_id", "code", F.col("d").cast("date").alias("effective_date"), "price_resident", "seq").write.mode("append").parquet(source)
    write([("p", "c", "2024-01-01", 10.0, "1"), ("p", "c", "2025-01-01", 12.0, "2")])
    run = lambda: once(spark.readStream.schema(SCHEMA).parquet(source), checkpoint, append_new(store, "seq", "price_resident")).awaitTermination()
    run()
    run()
    write([("p", "c", "2023-01-01", 9.0, "3"), ("p", "c", "2025-01-01", 12.0, "2")])
    run()
    rows = current(spark, store, ["partner_id", "code"], ["seq"]).collect()
    assert {r["seq"]: r["is_active"] for r in rows} == {"1": False, "2": True, "3": False}


def test_event_time(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,cast(id * 30 as decimal(18,6))) as ts, cast(id % 4 as string) as k from range(20)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(source)
    for name, df, mode in (("deduplicated_keys", deduplicated(stream, "k", "ts", "1 hour"), "append"), ("windows", windowed_counts(stream, "ts", "1 minute", "5 minutes"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("deduplicated_keys").count() == 4
    assert [r["n"] for r in spark.table("windows").orderBy("window").collect()] == [10, 10]
