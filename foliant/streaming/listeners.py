"""Observers of streams: what is known of a stream is told to all who listen, at once and after each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Observers(StreamingQueryListener):
    """Keeps the last state of the session's streams and tells it to subscribers."""

    def __init__(self, spark: SparkSession):
        self.spark, self.state, self.told = spark, {"status": "idle", "batch": -1, "rows": 0, "error": None}, []
        spark.streams.addListener(self)

    def subscribe(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Tell the state now and after every change; returns a function that ends it."""
        self.told.append(listener)
        listener(dict(self.state))
        return lambda: self.told.remove(listener) if listener in self.told else None

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def _tell(self, **changes) -> None:
        self.state |= changes
        for listener in list(self.told):
            listener(dict(self.state))

    def onQueryStarted(self, event) -> None:
        self._tell(status="running", error=None)

    def onQueryProgress(self, event) -> None:
        self._tell(batch=event.progress.batchId, rows=self.state["rows"] + event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._tell(status="waiting")

    def onQueryTerminated(self, event) -> None:
        self._tell(status="error" if event.exception else "ended", error=event.exception)
