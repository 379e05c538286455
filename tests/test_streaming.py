import datetime as dt

from gridloom.streaming.arrivals import daily_sums, latest, run_to_end

T = lambda d, h: dt.datetime(2024, 1, d, h)
SCHEMA = "ts timestamp, user_id long, value double"


def test_late_records_change_their_day(spark, tmp_path):
    arrivals, path = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
    run = lambda: run_to_end(daily_sums(spark.readStream.schema(SCHEMA).parquet(arrivals), "ts", "user_id", "value"), path)
    add([(T(1, 3), 1, 1.5), (T(2, 3), 1, 2.0), (T(2, 4), 2, 1.0)])
    run()
    add([(T(1, 9), 1, 0.25), (T(3, 1), 2, 4.0)])
    run()
    got = {(r.user_id, r.time.day): (r.value, r.n) for r in latest(spark, path, "user_id", "time").collect()}
    assert got == {(1, 1): (175, 2), (1, 2): (200, 1), (2, 2): (100, 1), (2, 3): (400, 1)}
    table = daily_sums(spark.read.parquet(arrivals), "ts", "user_id", "value")
    assert {(r.user_id, r.time.day): (r.value, r.n) for r in table.collect()} == got
