from pyspark.sql import functions as F

from cairnfield.streaming.density import windowed_density


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 5}:10:00", float(i % 7) * 10, float(i % 3) * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "ts string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_density(stream, 15.0).writeStream.format("memory").queryName("heat").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: tuple(r)
    assert sorted(spark.table("heat").collect(), key=key) == sorted(windowed_density(df, 15.0).collect(), key=key)
