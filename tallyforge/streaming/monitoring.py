"""What runs: counters of streams, pushed alerts, and health."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyforge.operators.observability import BUCKETS_NS, exposition, histogram_text
from tallyforge.streaming.alert_stream import start_alerts

#: What the code that runs streams counts.
COUNTERS = {
    "events_ingested_total": "Events stored, by mode",
    "events_duplicate_total": "Events that were stored before",
    "alerts_recorded_total": "Alerts written",
    "alerts_pushed_total": "Alerts handed to receivers",
}
#: By the name of a duration that streams report: its series.
DURATIONS = {"triggerExecution": ("batch_duration_seconds", "Whole batches"), "addBatch": ("ingest_duration_seconds", "Processing of batches"), "walCommit": ("log_commit_duration_seconds", "Commits of the write-ahead log")}


class StreamCounters(StreamingQueryListener):
    """Counts what all streams of a session do; add it with ``spark.streams.addListener``. Streams report rows, batches and
    durations themselves; ``add`` counts what only the code that runs them knows."""

    def __init__(self) -> None:
        self._lock, self.began = threading.Lock(), time.time()
        self.rows, self.batches, self.started, self.ended = 0, 0, 0, 0
        self.counts: Counter = Counter()
        self.state: dict[str, tuple[int, int]] = {}
        self.durations: dict[str, list[int]] = {kind: [0] * (len(BUCKETS_NS) + 2) for kind in DURATIONS}

    def add(self, name: str, n: int = 1, **labels: str) -> None:
        """Counts one of COUNTERS."""
        if name not in COUNTERS:
            raise ValueError(f"unknown counter {name}")
        with self._lock:
            self.counts[name, tuple(sorted(labels.items()))] += n

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.started += 1

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            self.batches += 1
            self.rows += progress.numInputRows
            self.state[str(progress.id)] = (sum(s.numRowsTotal for s in progress.stateOperators), sum(s.memoryUsedBytes for s in progress.stateOperators))
            for kind, held in self.durations.items():
                if (ms := progress.durationMs.get(kind)) is not None:
                    held[bisect_left(BUCKETS_NS, ms * 1_000_000)] += 1
                    held[-1] += ms * 1_000_000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended += 1

    def render(self, rollup: DataFrame | None = None, subscribers: int = 0) -> str:
        """The series as text for a monitoring system; of a rollup, if given, the live keys."""
        keys = 0 if rollup is None else rollup.count()
        with self._lock:
            counted = {name: [(dict(labels), n) for (c, labels), n in sorted(self.counts.items()) if c == name] or [({}, 0)] for name in COUNTERS}
            found = [("counter", "stream_rows_total", "Rows read by streams", [({}, self.rows)]), ("counter", "stream_batches_total", "Batches run by streams", [({}, self.batches)])]
            found += [("counter", name, text, counted[name]) for name, text in COUNTERS.items()]
            gauges = {"streams_running": ("Streams that run", self.started - self.ended), "alert_subscribers": ("Receivers of pushed alerts", subscribers), "agg_keys": ("Live aggregate keys", keys)}
            gauges |= {"state_rows": ("Rows of streams' state", sum(r for r, _ in self.state.values())), "state_bytes": ("Memory of streams' state", sum(b for _, b in self.state.values()))}
            found += [("gauge", name, text, [({}, value)]) for name, (text, value) in gauges.items()]
            text = "".join(exposition(*x) for x in found)
            return text + "".join(histogram_text(name, help_text, self.durations[kind][:-1], self.durations[kind][-1]) for kind, (name, help_text) in DURATIONS.items())

    def health(self) -> dict:
        return {"status": "ok", "uptime_seconds": int(time.time() - self.began)}


def pages(rows: DataFrame, page: int) -> Iterator[list[Row]]:
    """Rows, so many at a time; the driver holds one page at most beyond what Spark fetches of a partition."""
    held: list[Row] = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == page:
            yield held
            held = []
    if held:
        yield held


def push_alerts(events: DataFrame, metrics: DataFrame, deliver: Callable[[int, list[Row]], None], target: str, checkpoint: str, page: int = 1000, counters: StreamCounters | None = None, **trigger) -> StreamingQuery:
    """Runs alerts over a stream of events and hands each batch's on, ``page`` rows at a time, with the batch's id: a batch that runs
    again comes with the same id and the same alerts, so a receiver can tell."""

    def batch(fired: DataFrame, batch_id: int) -> None:
        for some in pages(fired, page):
            deliver(batch_id, some)
            if counters:
                counters.add("alerts_recorded_total", len(some))
                counters.add("alerts_pushed_total", len(some))

    return start_alerts(events, metrics, target, checkpoint, batch, **trigger)
