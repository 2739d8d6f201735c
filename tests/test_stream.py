"""The stream's last known delays equal the table's, whatever the order in which files come."""

from datetime import datetime, timedelta

from stellwerk.streaming.last_known import last_known_stream

SCHEMA = "run_id string, time timestamp, index int, is_arr boolean, delay int"
START = datetime(2031, 3, 4, 8)


def test_stream_equals_table(spark, tmp_path):
    rows = [("x", START + timedelta(minutes=m), k, a, d) for m, k, a, d in ((0, 1, False, 2), (20, 2, True, 4), (20, 2, False, 5), (70, 3, True, 1))]
    rows += [("y", START + timedelta(minutes=10), 1, False, 0), ("y", START + timedelta(minutes=5), 0, True, 7)]
    for part in (rows[3:], rows[:3]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = last_known_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="2 hours")
    sink = stream.writeStream.format("memory").queryName("last_known_delays").outputMode("complete").option("checkpointLocation", str(tmp_path / "state"))
    sink.trigger(availableNow=True).start().awaitTermination(90)
    found = {(r.run_id, r.window.start): (r.time, r.delay) for r in spark.table("last_known_delays").collect()}
    table = {(r.run_id, r.window.start): (r.time, r.delay) for r in last_known_stream(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == table and sorted((k[0], v[1]) for k, v in found.items()) == [("x", 1), ("x", 5), ("y", 0)]
