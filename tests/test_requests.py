import json

from pyspark.sql import functions as F

from glyphmill.operators import library
from glyphmill.streaming import requests

SCHEMA = "user_id string, scope string, key string, request_id string, request_hash string, requested_at timestamp"


def run(spark, folder, rows, number):
    """One run over what is new, from the checkpoint that the last one left."""
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{number}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.schema(SCHEMA).json(f"file://{folder}/in")
    made = requests.request_outcomes(stream, ttl_seconds=3600, delay="1 minute")
    query = made.writeStream.format("parquet").option("checkpointLocation", f"file://{folder}/checkpoint").option("path", f"file://{folder}/out").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return {(r.key, r.request_id): r.outcome for r in spark.read.parquet(f"file://{folder}/out").collect()}


def row(key, request, body, at):
    return {"user_id": "u", "scope": "s", "key": key, "request_id": request, "request_hash": body, "requested_at": f"2024-05-01T{at}:00.000Z"}


def test_requests_are_remembered_over_a_restart_and_freed_by_time(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    requests.with_store(spark)
    try:
        first = [row("a", "1", "x", "10:00"), row("a", "2", "x", "10:10"), row("b", "3", "y", "10:20"), row("a", "4", "z", "10:30")]
        assert run(spark, tmp_path, first, 1) == {("a", "1"): "RUN", ("a", "2"): "REPLAY", ("b", "3"): "RUN", ("a", "4"): "CONFLICT"}
        second = [row("a", "5", "x", "10:59"), row("a", "6", "z", "11:00"), row("a", "7", "z", "11:30"), row("b", "8", "y", "10:00"), row("c", "9", "w", "10:45")]
        found = run(spark, tmp_path, second, 2)
        # 8 came after the watermark; 6 came when the first lifetime had ended, so it runs and 7 replays it
        assert {k: found.get(k) for k in [("a", "5"), ("a", "6"), ("a", "7"), ("b", "8"), ("c", "9")]} == {("a", "5"): "REPLAY", ("a", "6"): "RUN", ("a", "7"): "REPLAY", ("b", "8"): None, ("c", "9"): "RUN"}
        third = [row("b", "10", "other", "13:00"), row("a", "11", "z", "13:00")]
        found = run(spark, tmp_path, third, 3)
        assert (found["b", "10"], found["a", "11"]) == ("RUN", "RUN")
        taken = [r for r in first + second + third if r["request_id"] != "8"]
        batch = library.idempotent_requests(spark.createDataFrame([(*list(r.values())[:5], r["requested_at"]) for r in taken], SCHEMA.replace("timestamp", "string")).withColumn("requested_at", F.to_timestamp("requested_at")), 3600)
        assert {(r.key, r.request_id): r.outcome for r in batch.collect()} == found
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
