from __future__ import annotations

from trajecta.streaming.steps import fixation_stream, sessions, windowed_statistics


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(k, float(t), float(x), 0.0) for k in ("a", "b") for t, x in [(i, 0.01 * i) for i in range(10)] + [(10 + i, 5 + 0.01 * i) for i in range(10)] + [(4000, 1e9)]]
    table = spark.createDataFrame(rows, "p string, t double, x double, y double").selectExpr("*", "timestamp_seconds(1700000000 + t) as ts")
    table.where("t < 4000").coalesce(1).write.parquet(str(tmp_path / "in"))
    table.where("t = 4000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def read():
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    out = drain(windowed_statistics(read(), "p", "ts", "x", "10 seconds", "1 second"), "stats")
    assert len(out) >= 4 and all(r["n"] > 0 for r in out)
    assert {r["n"] for r in drain(sessions(read(), "p", "ts", "30 seconds", "1 second"), "spans")} == {20}
    found = sorted((r["p"], r["start_time"], r["end_time"], r["n"]) for r in drain(fixation_stream(read(), "p", 0.5, late="1 second"), "fix"))
    assert ("a", 0.0, 8.0, 9) in found and ("b", 10.0, 18.0, 9) in found
