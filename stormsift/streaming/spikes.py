"""Spike windows on a stream: per service, rolling sums over minutes held in state and closed by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stormsift.params import DEFAULT, MINUTE, Detector, Params

OUT = "service string, kind string, start_us long, end_us long, peak_count long, baseline_per_min double, alarm_id string"
_MS = MINUTE // 1000


class SpikeDetector(StatefulProcessor):
    """State of a service: counts of minutes that still matter, the minute up to which all is decided, and the window that
    is open for each detector. A minute is decided once the watermark has passed the last minute of its rolling sum."""

    def __init__(self, detectors: tuple[Detector, ...], gap: int, slack_minutes: int):
        self.detectors, self.gap, self.slack = detectors, gap, slack_minutes
        self.reach = max(d.half for d in detectors)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long", "n long")
        self.done = handle.getValueState("done", "minute long, baseline double")
        self.open = handle.getMapState("open", "kind string", "first long, last long, peak long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get() if self.done.exists() else None
        late, baseline = [], done[1] if done else None
        for batch in rows:
            baseline = float(batch["baseline"].iloc[0]) if baseline is None else baseline
            for minute, part in batch.groupby("minute"):
                if done and minute <= done[0]:
                    late += [(key[0], "late", int(us), int(us), 1, baseline, a) for us, a in zip(part["us"], part["alarm_id"], strict=True)]
                    continue
                old = self.counts.getValue((int(minute),))[0] if self.counts.containsKey((int(minute),)) else 0
                self.counts.updateValue((int(minute),), (old + len(part),))
        if baseline is not None:
            minutes = [k[0] for k in self.counts.keys()]
            first = min(minutes, default=None)
            if not done and first is not None:
                self.done.update((first - self.reach - 1, baseline))
            if first is not None:
                self._wake(timerValues)
        if late:
            yield pd.DataFrame(late, columns=[c.split()[0] for c in OUT.split(", ")])

    def _wake(self, timers) -> None:
        """One timer a minute of event time, as long as anything is undecided."""
        now = max(timers.getCurrentWatermarkInMs(), 0)
        self.handle.registerTimer(now + _MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, baseline = self.done.get()
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        closed = timerValues.getCurrentWatermarkInMs() // _MS - 1 + self.slack  # minutes up to here get no more alarms
        out, last = [], max(counts, default=done)
        upto = min(closed - self.reach, last + self.reach + self.gap + 1)
        spans = {k[0]: list(v) for k, v in self.open.iterator()}
        for minute in range(done + 1, upto + 1):
            for d in self.detectors:
                rolling = sum(counts.get(m, 0) for m in range(minute - d.half, minute + d.half + 1))
                span = spans.get(d.kind)
                if span and minute - span[1] > self.gap:
                    out.append(self._window(key[0], d, span, baseline))
                    span = spans.pop(d.kind)
                    span = None
                if rolling > max(float(d.min_count), baseline * d.multiplier + d.margin):
                    n = counts.get(minute, 0)
                    spans[d.kind] = [span[0], minute, max(span[2], n)] if span else [minute, minute, n]
        upto = max(upto, done)
        for d in self.detectors:
            if d.kind in spans:
                self.open.updateValue((d.kind,), tuple(spans[d.kind]))
            elif self.open.containsKey((d.kind,)):
                self.open.removeKey((d.kind,))
        for m in counts:
            if m < upto - self.reach:
                self.counts.removeKey((m,))
        self.done.update((upto, baseline))
        if spans or any(m >= upto - self.reach for m in counts):
            self._wake(timerValues)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _window(self, service: str, d: Detector, span: list[int], baseline: float) -> tuple:
        return (service, d.kind, (span[0] - d.half) * MINUTE, (span[1] + 1 + d.half) * MINUTE, span[2], baseline, None)

    def close(self) -> None:
        pass


def stream_spikes(alarms: DataFrame, baseline: DataFrame, late_minutes: int = 10, side_minutes: int = 50, p: Params = DEFAULT) -> DataFrame:
    """Spike windows of a stream of (alarm_id, ts, service), by a table (service, baseline), and late alarms.

    Rows of kind burst or slow are windows that closed; rows of kind late are alarms (start_us, alarm_id) that came after
    their minute was decided. Minutes are decided late_minutes behind the latest alarm; Spark's own watermark lies side_minutes
    further back, so that late alarms still reach the state and are told apart, not dropped; what is later than both counts
    in the query's progress as dropped by the watermark. Minutes are clock minutes. Services without a baseline have 0.

    State is a few minutes of counts for each service, so it follows the number of services; it needs the session's state
    store to be RocksDB. A restart from the checkpoint goes on where the query stopped.
    """
    minutes = F.floor(F.unix_micros("ts") / MINUTE).cast("long").alias("minute")
    rows = alarms.withWatermark("ts", f"{late_minutes + side_minutes} minutes").join(baseline.select("service", F.col("baseline").cast("double").alias("baseline")), "service", "left")
    rows = rows.select("alarm_id", "ts", "service", F.unix_micros("ts").alias("us"), minutes, F.coalesce("baseline", F.lit(0.0)).alias("baseline"))
    detector = SpikeDetector((p.burst, p.slow), p.island_gap, side_minutes)
    return rows.groupBy("service").transformWithStateInPandas(detector, outputStructType=OUT, outputMode="append", timeMode="EventTime")
