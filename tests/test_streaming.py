from smoothspan.sources.sinks import append_jsonl
from smoothspan.streaming.events import event_stream, fold_progress


def test_event_log_stream(spark, tmp_path):
    for k in range(3):
        append_jsonl(tmp_path / "logs" / "events.jsonl", {"level": "INFO", "event": "fold_completed", "model_id": "m", "repeat": 1, "fold": k, "log_loss": 0.5 + k})
    append_jsonl(tmp_path / "logs" / "events.jsonl", {"level": "INFO", "event": "run_completed"})
    query = fold_progress(event_stream(spark, str(tmp_path / "logs"))).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("progress").collect()
    assert sum(r["folds"] for r in rows) == 3 and {r["model_id"] for r in rows} == {"m"}
