import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tamiz.operators import logs
from tamiz.streaming import signatures as S


def _write(folder, name, events):
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def _event(i, ts, text):
    return {"file": "a", "line_no": i, "kind": "stamped", "stamp": ts.isoformat(), "lines": [text], "ts": ts.isoformat()}


def test_stream_equals_batch(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    start = datetime(2026, 1, 1)
    for f in range(3):
        _write(folder, f"{f}.json", [_event(f * 100 + i, start + timedelta(minutes=f * 40 + i), f"2026-01-01 00:00:00 ERROR X{i % 3}Exception: fila {i}") for i in range(40)])
    latest = {}

    def keep(df, epoch):
        for r in df.collect():
            latest[(r["start"], r["hash"])] = r["count"]

    S.start_upserts(S.stream_signatures(S.read_event_stream(spark, str(folder), 1)), keep, check).awaitTermination()
    batch = logs.describe_events(spark.read.schema(S.EVENTS).json(str(folder)))
    want = {(r["w"]["start"], r["hash"]): r["n"] for r in batch.groupBy(F.window("ts", "1 hour").alias("w"), "hash").agg(F.count("*").alias("n")).collect()}
    assert latest == want and len(want) == 6


def test_late_events_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    start = datetime(2026, 1, 1)
    stream = S.stream_signatures(S.read_event_stream(spark, str(folder), 1))
    q = stream.writeStream.outputMode("update").format("memory").queryName("late_sig").option("checkpointLocation", str(tmp_path / "c")).start()
    dropped = 0
    for i, minutes in enumerate((0, 600, 1)):
        _write(folder, f"{i}.json", [_event(i, start + timedelta(minutes=minutes), "2026-01-01 00:00:00 ERROR AException")])
        q.processAllAvailable()
    dropped = sum(S.late_rows(p) for p in q.recentProgress)
    q.stop()
    assert dropped == 1


def test_redacted_stream_and_first_sight(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    start = datetime(2026, 1, 1)
    _write(folder, "a.json", [_event(i, start + timedelta(seconds=i), f"2026-01-01 00:00:00 ERROR AException: 12345678Z {i}") for i in range(5)])
    events = S.read_event_stream(spark, str(folder))
    out = S.stream_redact(events.withColumn("text", F.get("lines", F.lit(0)))).select("text")
    q = out.writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("redacted").where("text LIKE '%[PII]%'").count() == 5
    q = S.first_sight(events).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1
