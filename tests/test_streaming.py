from __future__ import annotations

from pyspark.sql import functions as F

from presswerk.streaming import intake

SCHEMA = "url_hash string, source string, collected_at timestamp, published_at timestamp"


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def items(spark, tmp_path):
    rows = [("a", "s", "2026-01-01 10:00:00", "2026-01-01 09:00:00"), ("a", "s", "2026-01-01 11:00:00", None), ("b", "s", "2026-01-01 12:00:00", "2025-01-01 00:00:00"), ("c", "t", "2026-01-05 12:00:00", None)]
    df = spark.createDataFrame(rows, "url_hash string, source string, c string, p string").select("url_hash", "source", F.col("c").cast("timestamp").alias("collected_at"), F.col("p").cast("timestamp").alias("published_at"))
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_first_seen_and_fresh(spark, tmp_path):
    batch, stream = items(spark, tmp_path)
    assert {r["url_hash"] for r in run(spark, intake.first_seen(stream), "seen").collect()} == {"a", "b", "c"}
    assert run(spark, intake.fresh(stream), "fresh").count() == intake.fresh(batch).count() == 3


def test_daily_counts_equal_batch(spark, tmp_path):
    batch, stream = items(spark, tmp_path)
    got = run(spark, intake.daily_counts(stream), "daily", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intake.daily_counts(batch).collect()))
    assert run(spark, intake.sliding_counts(stream), "sliding", "complete").count() == intake.sliding_counts(batch).count()


def test_against_history(spark, tmp_path):
    _, stream = items(spark, tmp_path)
    out = str(tmp_path / "out")
    history = lambda: spark.createDataFrame([("b",)], "url_hash string")
    f = intake.against_history(lambda d, n: d.write.mode("append").parquet(out), history)
    stream.writeStream.foreachBatch(f).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["url_hash"] for r in spark.read.parquet(out).collect()) == ["a", "c"]


def test_attempts(spark, tmp_path):
    spark.createDataFrame([("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "completed"), ("c", 1, "failed")], "url_hash string, seq int, status string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("url_hash string, seq int, status string").parquet(str(tmp_path / "ev"))
    got = {r["url_hash"]: r["action"] for r in run(spark, intake.attempts(stream), "attempts", "update").collect()}
    assert got == {"a": "drop", "b": "done", "c": "retry"}
