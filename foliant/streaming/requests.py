"""Requests as streams: pieces put in order, stale and silent requests ended, messages met with their answers in time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.streaming.sessions import FAILED, TIMEOUT_SECONDS

#: Stateful functions need this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Event types that end a request, and how each is reported.
ENDS = {"generate-complete": "complete", "generate-error": "error", "interrupt-complete": "interrupted"}
TRACKED = "session_id long, request_id long, seq long, kind string, text string"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that start here may use stateful functions."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Tracker(StatefulProcessor):
    """One session at a time: its current request, the next piece it waits for, pieces that came early, and a timer.

    Events of a batch are taken by their times. Only the newest request counts: events of older ones are reported as ``stale``, and a newer one ends it as ``superseded``. Pieces are
    passed on in the order of ``seq`` (from 0); one that comes early waits in the state, a repeated one is dropped. If nothing
    comes for ``timeout`` seconds of event time the request is ``expired``, what waits is given up, and its state is cleared.
    """

    def __init__(self, timeout: int = TIMEOUT_SECONDS):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "request_id long, next long, open boolean, timer long")
        self.early = handle.getMapState("early", "seq long", "type string, text string")

    def _set_timer(self, old: int | None, at: int | None) -> None:
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if at is not None and old != at:
            self.handle.registerTimer(at)

    def _give_up(self) -> None:
        for seq in [k[0] for k in self.early.keys()]:
            self.early.removeKey((seq,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "request_id", "seq"], kind="stable")
        state = self.current.get()
        request, following, is_open, timer = state if state is not None else (None, 0, False, None)
        out, began, latest = [], timer, None
        for r, seq, kind, text, ts in events[["request_id", "seq", "type", "text", "ts"]].itertuples(index=False, name=None):
            if request is not None and (r < request or (r == request and not is_open)):
                out.append((key[0], r, seq, "stale", None))
                continue
            if r != request:
                if is_open:
                    out.append((key[0], request, following, "superseded", None))
                self._give_up()
                request, following, is_open, latest = r, 0, True, None
            at = int(ts.timestamp() * 1000) + self.timeout * 1000
            latest = at if latest is None else max(latest, at)
            if seq < following:
                continue
            self.early.updateValue((int(seq),), (kind, text))
            while is_open and self.early.containsKey((following,)):
                kind, text = self.early.getValue((following,))
                self.early.removeKey((following,))
                ended = ENDS.get(kind)
                out.append((key[0], request, following, ended or "piece", text))
                following += 1
                if ended:
                    is_open = False
                    self._give_up()
        if not is_open:
            timer = None
        elif latest is not None:
            timer = latest if request != (state[0] if state is not None else None) or timer is None else max(timer, latest)
        self._set_timer(began, timer)
        self.current.update((request, following, is_open, timer))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "request_id", "seq", "kind", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        request, following, is_open, timer = self.current.get()
        if is_open and timer == expiredTimerInfo.getExpiryTimeInMs():
            self._give_up()
            self.current.update((request, following, False, None))
            yield pd.DataFrame([(key[0], request, following, "expired", None)], columns=["session_id", "request_id", "seq", "kind", "text"])

    def close(self) -> None:
        pass


def track(events: DataFrame, *, late: str = "30 seconds", timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """A stream of (session_id, request_id, seq, type, text, ts) to what each request passes on, in order: see ``Tracker``.

    Each key's state is one request and its early pieces. Events that are later than the watermark are still taken if their request is open.
    Start the query within ``stateful``.
    """
    keyed = events.withWatermark("ts", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(Tracker(timeout), TRACKED, "Append", "EventTime")


def answered(messages: DataFrame, answers: DataFrame, *, within: str = "90 seconds", late: str = "30 seconds") -> DataFrame:
    """(conv_id, turn, asked_at, text, said): each message (conv_id, turn, text, asked_at) with its answer (conv_id, turn, text, answered_at).

    An answer counts if it comes within the interval after its message. For streams this is an outer join of two streams: a
    message that has none is let out with null once the watermark is past the interval, and both sides' state is bounded
    by it. Batches give the same rows. Several answers in time are several rows; a null key or time is without an answer (streams drop such a message).
    """
    a = answers.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("said"), "answered_at").withWatermark("answered_at", late)
    m = messages.select("conv_id", "turn", "text", "asked_at").withWatermark("asked_at", late)
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return m.join(a, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")) & in_time, "left_outer").select("conv_id", "turn", "asked_at", "text", "said")


def timed_log(messages: DataFrame, answers: DataFrame, **times: str) -> DataFrame:
    """(conv_id, ord, turn, role, text): what a chat log appends, each message and then its answer or why there is none.

    ``ord`` is 2 * turn and 2 * turn + 1, which needs no numbering over what has been written, so streams can append.
    """
    both = answered(messages, answers, **times)
    rows = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce("said", F.lit(FAILED)).alias("text")))
    return both.select("conv_id", "turn", F.posexplode(rows).alias("at", "row")).select("conv_id", (2 * F.col("turn") + F.col("at")).cast("long").alias("ord"), "turn", "row.*")


def activity(events: DataFrame, *, ts: str = "ts", length: str = "10 minutes", slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = (), value: Column | None = None) -> DataFrame:
    """(keys, started, ended, n, total): events in tumbling windows, or sliding ones with ``slide``. Rows later than the watermark allows are left out by streams."""
    spans = F.window(ts, length, slide) if slide else F.window(ts, length)
    total = F.sum(F.lit(0.0) if value is None else value)
    out = events.withWatermark(ts, late).groupBy(*keys, spans.alias("w")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")
