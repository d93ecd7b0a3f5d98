from pyspark.sql import functions as F

from docloom.functions import strings
from docloom.streaming import windows


def test_a_stream_gives_what_a_table_gives(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = windows.read_stream(spark, f"{tmp_path}/in", events.schema, 1)
    pick = lambda df: df.where(strings.like("event_type", "PUR%")).select("event_id", "value")
    windows.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", pick)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(pick(events).collect())
    windows.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", pick)
    assert spark.read.parquet(f"{tmp_path}/out").count() == pick(events).count()


def test_windows_and_sessions_count_each_event_once(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    hourly = windows.windowed(events, "ts", "1 hour", by=["event_type"], n=F.count("*"))
    assert hourly.agg(F.sum("n")).first()[0] == events.count()
    assert windows.sessions(events, "ts", "30 minutes", ["user_id"], n=F.count("*")).agg(F.sum("n")).first()[0] == events.count()
