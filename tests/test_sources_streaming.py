import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lattiq import sources, streaming  # noqa: E402
from lattiq.plans.panel import bars  # noqa: E402

SF = "/root/testdata/sf0.001"


def ticks(df):
    return df.select("ts", F.col("event_type").alias("code"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("size"))


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming.bars(ticks(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("bars_out").select("date", "code", "open", "high", "low", "close", "volume").collect())
    want = sorted(tuple(r) for r in bars(ticks(events).withColumn("ts", F.col("ts").cast("timestamp")), "hour").select("date", "code", "open", "high", "low", "close", "volume").collect())
    assert got == want


def test_csv_with_other_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Trade_Date,symbol,O,h,l,close,vol\n20240102,x,1,2,1,NaN,5\n2024-01-03,x,1,2,1,2,6\n")
    df = sources.read_panel(spark, str(tmp_path / "a.csv"), "csv", "Trade_Date string, symbol string, O double, h double, l double, close double, vol double")
    rows = df.orderBy("date").collect()
    assert df.columns == ["date", "code", "open", "high", "low", "close", "volume"] and rows[0].close is None and str(rows[1].date) == "2024-01-03"


def test_lake_and_partitions(spark, tmp_path):
    p = spark.createDataFrame([("2024-01-02", 1.0), ("2025-01-02", 2.0)], "date string, close double").withColumn("date", F.to_date("date"))
    p.toPandas().to_parquet(tmp_path / "abc.parquet")
    df = sources.read_lake(spark, str(tmp_path))
    assert {r.code for r in df.collect()} == {"abc"}
    sources.write_panel(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("year = 2025").count() == 1
