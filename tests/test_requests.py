"""Streams of requests, messages and events, fed batch by batch, against what the rows say as a whole."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.streaming import requests
from foliant.streaming.sessions import FAILED

T0 = datetime(2024, 5, 1)
EVENTS = "session_id long, request_id long, seq long, type string, text string, ts timestamp"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Feed:
    """A folder that a stream reads; ``put`` adds one file, ``run`` lets the stream take what is new."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(self.path)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(df, path, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(tmp_path / f"checkpoint-{path.name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_tracker(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    batches = [
        [(1, 1, 0, "chunk", "a", at(0)), (1, 1, 2, "chunk", "c", at(2)), (2, 5, 0, "chunk", "x", at(1))],  # seq 1 is late
        [(1, 1, 1, "chunk", "b", at(3)), (1, 1, 1, "chunk", "b", at(3)), (1, 1, 3, "generate-complete", "abc", at(4)), (1, 1, 4, "chunk", "more", at(5))],  # in order again, a repeat, the end, one too many
        [(1, 3, 0, "chunk", "new", at(40)), (1, 2, 0, "chunk", "old", at(41))],  # request 2 is older than 3
        [(3, 1, 0, "chunk", "far ahead", at(300))],  # the watermark passes 90 s after what sessions 1 and 2 said last
        [(2, 5, 1, "chunk", "too late", at(301)), (1, 4, 0, "chunk", "again", at(302)), (1, 5, 1, "chunk", "waits", at(303))],
    ]
    with requests.stateful(spark):
        for rows in batches:
            feed.put(rows)
            run(requests.track(feed.stream()), tmp_path / "out", tmp_path)
    got = sorted((r["session_id"], r["request_id"], r["seq"], r["kind"], r["text"] or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([
        (1, 1, 0, "piece", "a"), (1, 1, 1, "piece", "b"), (1, 1, 2, "piece", "c"), (1, 1, 3, "complete", "abc"), (1, 1, 4, "stale", ""), (1, 2, 0, "stale", ""), (1, 3, 0, "piece", "new"), (1, 3, 1, "expired", ""),
        (1, 4, 0, "piece", "again"), (1, 4, 1, "superseded", ""), (2, 5, 0, "piece", "x"), (2, 5, 1, "expired", ""), (2, 5, 1, "stale", ""), (3, 1, 0, "piece", "far ahead"),
    ])


def chats(spark):
    """The conversations' turns, one each ten seconds; some answers come too late, some not at all."""
    m = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    said = m.where("role = 'user'").select("conv_id", "turn", "text", F.timestamp_seconds(F.lit(1.7e9) + F.col("conv_id") * 7 + F.col("turn") * 200).alias("asked_at"))
    wait = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, 95).otherwise((F.col("conv_id") * 13) % 90)
    answers = m.where("role = 'assistant' and conv_id % 7 <> 3").select("conv_id", (F.col("turn") - 1).alias("turn"), "text", F.timestamp_seconds(F.lit(1.7e9) + F.col("conv_id") * 7 + (F.col("turn") - 1) * 200 + wait).alias("answered_at"))
    return said, answers


def test_stream_of_messages_equals_batch(spark, tmp_path):
    said, answers = chats(spark)
    whole = requests.timed_log(said, answers)
    want = sorted(map(tuple, whole.collect()))
    assert any(r[-1] == FAILED for r in want) and any(r[-2] == "assistant" and r[-1] != FAILED for r in want)
    a, b = Feed(spark, tmp_path / "said", said.schema), Feed(spark, tmp_path / "answers", answers.schema)
    first, last = (said.agg(f("asked_at")).first()[0] for f in (F.min, F.max))
    third = (last - first) / 3
    for k in range(3):
        lo, hi = first + k * third, first + (k + 1) * third + timedelta(seconds=k == 2)
        a.put(said.where((F.col("asked_at") >= F.lit(lo)) & (F.col("asked_at") < F.lit(hi))).collect())
        b.put(answers.where((F.col("answered_at") >= F.lit(lo)) & ((F.col("answered_at") < F.lit(hi)) | F.lit(k == 2))).collect())
        run(requests.timed_log(a.stream(), b.stream()), tmp_path / "log", tmp_path)
    end = last + timedelta(hours=1)
    a.put([(-1, 0, "end", end)])  # moves the watermark past every message
    b.put([(-2, 0, "end", end)])
    run(requests.timed_log(a.stream(), b.stream()), tmp_path / "log", tmp_path)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).where("conv_id >= 0").collect()))
    assert got == want


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows_with_late_rows(spark, tmp_path, slide):
    schema = "ts timestamp, v double"
    feed = Feed(spark, tmp_path / "in", schema)
    batches = [[(at(60), 1.0), (at(599), 2.0), (at(600), 4.0)], [(at(4000), 8.0), (at(590), 16.0)], [(at(100), 32.0), (at(4100), 64.0)], [(at(20_000), 128.0)]]
    for rows in batches:  # the third has a row that is later than ten minutes after what was seen
        feed.put(rows)
        run(requests.activity(feed.stream(), slide=slide, late="10 minutes", value=F.col("v")), tmp_path / "out", tmp_path)
    timely = [r for rows in batches for r in rows if r[1] != 32.0]
    want = requests.activity(spark.createDataFrame(timely, schema), slide=slide, value=F.col("v")).where(F.col("ended") < F.lit(at(19_000)))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
