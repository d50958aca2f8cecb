"""Inactivity sessions and runtime states, the same in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_SECONDS = 90


def inactivity_sessions(events: DataFrame, *, key: str = "user_id", ts: str = "ts", timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Sessions that end when a key has been silent for ``timeout`` seconds. For streams, set a watermark first."""
    s = events.groupBy(key, F.session_window(ts, f"{timeout} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n_events")


def stream_sessions(events: DataFrame, *, late: str = "10 minutes", **kwargs) -> DataFrame:
    return inactivity_sessions(events.withWatermark(kwargs.get("ts", "ts"), late), **kwargs)


def cumulative_text(pieces: DataFrame) -> DataFrame:
    """(request_id, seq, text) of generated pieces to the text so far at each piece."""
    w = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("text_so_far", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), ""))


def progress_percent(value: Column, loaded: Column, total: Column) -> Column:
    """Whole per cent: of a value (up to 1 it is a share), else of what is loaded; null if neither is known."""
    scaled = F.when(value <= 1, value * 100).otherwise(value)
    share = F.when(total > 0, loaded / total * 100)
    return F.floor(F.coalesce(F.when(value.isNull() | F.isnan(value.cast("double")), None).otherwise(scaled), share) + 0.5).cast("int")


def progress_text(file: Column, percent: Column, status: Column, phase: str = "model") -> Column:
    """What a load shows: the file and its share, else the status, else that it is being prepared."""
    name = F.element_at(F.split(file, "/"), -1)
    shown = F.when(name.isNotNull() & percent.isNotNull(), F.concat(F.lit("Loading "), name, F.lit(" ("), percent.cast("string"), F.lit("%)"))).when(name.isNotNull(), F.concat(F.lit("Loading "), name, F.lit("…")))
    return F.coalesce(shown, F.when(F.trim(status) != "", F.concat(F.lit(f"{phase}: "), F.replace(status, F.lit("_"), F.lit(" ")))), F.lit(f"Preparing {phase}…"))


#: What stands in the log for an answer that failed, and for one that made no progress.
FAILED, STALLED = "The answer failed. Ask again.", "The answer made no progress and was stopped. Ask again, or ask less at once."


def chat_log(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, ord, turn, role, text): each user message followed by its answer, in order.

    Answers meet messages by (conv_id, turn); one that is missing, or whose text is null, is logged as failed, one
    with ``stalled`` set as stopped.
    """
    a = answers.withColumn("stalled", F.lit(False)) if "stalled" not in answers.columns else answers
    a = a.select("conv_id", "turn", F.col("text").alias("said"), "stalled")
    both = messages.select("conv_id", "turn", "text").join(a, ["conv_id", "turn"], "left")
    said = F.when(F.coalesce("stalled", F.lit(False)), STALLED).otherwise(F.coalesce("said", F.lit(FAILED)))
    rows = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit("assistant").alias("role"), said.alias("text")))
    each = both.select("conv_id", "turn", F.posexplode(rows).alias("at", "row")).select("conv_id", "turn", "at", "row.*")
    return each.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "at"))).select("conv_id", "ord", "turn", "role", "text")


def append_log(rows: DataFrame, path: str, *, checkpoint: str | None = None):
    """Append log rows to a table: a batch at once, or a stream exactly once with its own checkpoint folder."""
    if not rows.isStreaming:
        rows.write.mode("append").parquet(path)
        return None
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start()


# Event types and the status each leaves; the others leave it as it was.
STATUS = {"load-start": "loading", "load-progress": "loading", "load-ready": "ready", "load-error": "error", "generate-start": "generating", "generate-complete": "ready", "generate-error": "ready"}


def next_state(state: dict, kind: str, info: dict) -> dict:
    """One event of a runtime: its status, readiness, progress, error and finished text."""
    out = dict(state)
    if kind == "interrupt-complete":
        out["status"] = "ready" if state["ready"] else state["status"]
        return out
    if kind not in STATUS:
        return out
    out["status"] = STATUS[kind]
    if kind in ("load-start", "load-progress"):
        out["ready"] = False
        p = info.get("progress")
        if kind == "load-progress" and isinstance(p, int | float) and p == p:
            out["progress"] = int((p * 100 if p <= 1 else p) + 0.5)
    elif kind == "load-ready":
        out |= {"ready": True, "progress": 100, "error": None}
    elif kind == "load-error":
        out |= {"ready": False, "error": info.get("message") or "Model load failed."}
    return out


STATE = "status string, ready boolean, progress int, error string, n_events bigint"


def reduce_events(events: DataFrame, key: str = "request_id") -> DataFrame:
    """The last status of each key, in batch: what the last event that sets a status says."""
    pairs = [F.lit(x) for kv in STATUS.items() for x in kv]
    status = F.try_element_at(F.create_map(*pairs), F.col("type"))
    ready = F.when(F.col("type") == "load-ready", True).when(F.col("type").isin("load-start", "load-progress", "load-error"), False)
    order = F.col("seq")
    return events.withColumn("_s", status).withColumn("_r", ready).groupBy(key).agg(
        F.max_by("_s", F.when(F.col("_s").isNotNull(), order)).alias("last_status"), F.max_by("_r", F.when(F.col("_r").isNotNull(), order)).alias("ready"),
        F.max(F.when(F.col("_s").isNotNull(), order)).alias("_at"), F.max(F.when(F.col("type") == "interrupt-complete", order)).alias("_i"), F.count(F.lit(1)).alias("n_events"),
    ).select(key, F.when((F.col("_i") > F.coalesce("_at", F.lit(-1))) & F.coalesce("ready", F.lit(False)), "ready").otherwise(F.coalesce("last_status", F.lit("idle"))).alias("status"), F.coalesce("ready", F.lit(False)).alias("ready"), "n_events")


def stream_states(events: DataFrame, key: str = "request_id") -> DataFrame:
    """The same as a stateful stream: each key's state after each micro-batch with its events."""
    import json

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(("status", "ready", "progress", "error", "n_events"), state.get, strict=True)) if state.exists else {"status": "idle", "ready": False, "progress": 0, "error": None, "n_events": 0}
        rows = pd.concat(list(parts)).sort_values("seq")
        for kind, payload in zip(rows["type"], rows["payload"], strict=True):
            now = next_state(now, kind, json.loads(payload) if payload else {}) | {"n_events": now["n_events"] + 1}
        state.update(tuple(now[c] for c in ("status", "ready", "progress", "error", "n_events")))
        yield pd.DataFrame([{key: k[0], **now}])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} bigint, {STATE}", STATE, "update", "NoTimeout")
