"""What a running stream is at, as gauges (K8)."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener

from ..sources.sinks import metrics_text


class Gauges(StreamingQueryListener):
    """Add with ``spark.streams.addListener``; ``text()`` is for a scraper."""

    def __init__(self) -> None:
        self.streams: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event) -> None:
        self.streams[str(event.id)] = {"running": 1, "batches": 0, "rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.streams.setdefault(str(p.id), {"rows": 0})
        own |= {"running": 1, "batches": p.batchId + 1, "rows": own["rows"] + p.numInputRows, "batch_ms": p.durationMs.get("triggerExecution", 0)}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.streams.setdefault(str(event.id), {"rows": 0})["running"] = 0

    def text(self) -> str:
        """The sums over all streams, and how many run."""
        names = sorted({k for own in self.streams.values() for k in own})
        return metrics_text({k: sum(own.get(k, 0) for own in self.streams.values()) for k in names}, "changeloom_stream")
