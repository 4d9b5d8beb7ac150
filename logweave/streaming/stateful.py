"""Stateful stages of a stream that equal their batch stages: multi-line events, and anchored windows with bounded keyed states that become incidents.

State is kept by `transformWithStateInPandas` (RocksDB state store, see `CONF`), so a query that is started again from its checkpoint goes on where it was. Rows are folded in
order of their time once the watermark has passed them: how they are cut into micro-batches, and in which order they come within the watermark, changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave import constants as C
from logweave.functions.parsing import strip
from logweave.operators import correlate, windows
from logweave.session import Scratch
from logweave.sources.store import IncidentStore

#: What a session needs for these stages.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _provider(rows: DataFrame) -> None:
    for name, value in CONF.items():
        rows.sparkSession.conf.set(name, value)


# ------------------------------------------------------------------ multi-line events

EVENT = "file string, line_no long, event string, line_count long, first_line_is_header boolean, source string"


class Assembler(StatefulProcessor):
    """One log's open event between micro-batches: (number of the next line, whether the last line was blank, number of the event's first line, whether that is a header, its lines).

    An event that has got no line for `idle` seconds of processing time is given out as it is; what follows then begins a new one. Without `idle` it waits for its log's next line."""

    def __init__(self, idle: float | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, blank boolean")
        self.open = handle.getValueState("open", "line_no long, header boolean, lines string")

    def _event(self, log: str, line_no: int, header: bool, lines: list[str]) -> tuple:
        return log, line_no, " | ".join(lines), len(lines), header, "regex" if header else "orphan"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["part", "at"], kind="stable")
        number, blank = self.place.get() if self.place.exists() else (0, True)
        first, header, lines = self.open.get() if self.open.exists() else (None, None, "[]")
        lines, out = json.loads(lines), []
        for line, is_blank, is_header in zip(pdf["line"].tolist(), pdf["is_blank"].tolist(), pdf["is_header"].tolist(), strict=True):
            if not is_blank:
                if is_header or blank or first is None:
                    if lines:
                        out.append(self._event(key[0], first, header, lines))
                    first, header, lines = number, is_header, []
                lines.append(line)
            blank = is_blank
            number += 1
        if blank and lines:  # nothing can be added any more
            out.append(self._event(key[0], first, header, lines))
            lines = []
        self.place.update((number, bool(blank)))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if lines:
            self.open.update((int(first), bool(header), json.dumps(lines)))
            if self.idle is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["file", "line_no", "event", "line_count", "first_line_is_header", "source"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            first, header, lines = self.open.get()
            out.append(self._event(key[0], first, header, json.loads(lines)))
            self.open.clear()
            self.place.update((self.place.get()[0], True))
        yield pd.DataFrame(out, columns=["file", "line_no", "event", "line_count", "first_line_is_header", "source"])


def assemble(lines: DataFrame, log: Column | None = None, header: str = C.HEADER, idle: float | None = 30) -> DataFrame:
    """`segmentation.assemble` on a stream of lines (file, line_no, event): events of all lines of a log, whose files come in order of their names.

    log: what a file is part of; by default its name without a trailing number (app.log.3 and app.log.4 are parts of app.log). A number orders the parts, then the name. line_no counts the lines of a log through all
    its parts. Headers and blank lines are found by column expressions; only the fold of a log's lines is one task's. With `idle` the query waits for its timers, so it is run by a
    processing-time trigger and does not end by itself; `idle=None` is for runs over what is there (availableNow)."""
    _provider(lines)
    name = F.regexp_replace("file", r"[._-]?\d+$", "") if log is None else log
    part = F.concat(F.lpad(F.regexp_extract("file", r"(\d+)$", 1), 20, "0"), "file")
    text = F.col("event") if "event" in lines.columns else F.col("line")
    rows = lines.select(name.alias("log"), part.alias("part"), F.col("line_no").alias("at"), strip(text).alias("line"), (strip(text) == "").alias("is_blank"), text.rlike(header).alias("is_header"))
    return rows.groupBy("log").transformWithStateInPandas(Assembler(idle), EVENT, "Append", "None" if idle is None else "ProcessingTime")


# ------------------------------------------------------------------ windows and states

REPRESENTATIVE = "stream string, window_start long, state_key string, rep int, weight long, event_count long, window_events long, window_states long, coarsened long, payload string"
NAMES = [x.split()[0] for x in REPRESENTATIVE.split(", ")]
#: Rows that wait are kept by slices of time, in packs of at most PACK: a list would be one value of the store, which is read again whole with each row that is added.
PACK = 2000


class Windows(StatefulProcessor):
    """A stream's anchored window: rows that the watermark has not passed yet, the window's start and size, and at most `states` keyed states.

    A state has its number of events and its at most `most` representatives: highest risk, then earliest. Once there are states - 1 keys, all later ones share one.
    Waiting rows are read back, folded and given out one slice of time after the other."""

    def __init__(self, seconds: int, events: int, states: int, most: int):
        self.step, self.events, self.states, self.most = seconds * 1_000_000, events, states, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("packs", "slice long, number long", "rows string")
        self.sizes = handle.getMapState("slices", "slice long", "packs long")
        self.window = handle.getValueState("window", "start long, held long, keys long, coarsened long")
        self.kept = handle.getMapState("kept", "key string", "number long, reps string")

    def _wait(self, rows: list[tuple]) -> None:
        slices: dict[int, list[tuple]] = {}
        for row in rows:
            slices.setdefault(row[0] // self.step, []).append(row)
        for place, found in slices.items():
            packs = self.sizes.getValue((place,))[0] if self.sizes.containsKey((place,)) else 0
            for at in range(0, len(found), PACK):
                self.pending.updateValue((place, packs), (json.dumps(found[at : at + PACK]),))
                packs += 1
            self.sizes.updateValue((place,), (packs,))

    def _take(self, place: int) -> list[list]:
        rows = []
        for number in range(self.sizes.getValue((place,))[0]):
            rows += json.loads(self.pending.getValue((place, number))[0])
            self.pending.removeKey((place, number))
        self.sizes.removeKey((place,))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, read = 0, []
        for pdf in rows:
            us = pdf["us"].tolist()
            latest = max(latest, *us)
            read += zip(us, pdf["event_id"].tolist(), pdf["risk_score"].tolist(), pdf["state_key"].tolist(), pdf["payload"].tolist(), strict=True)
            if len(read) >= 20 * PACK:
                self._wait(read)
                read = []
        self._wait(read)
        self.handle.registerTimer(max(0, latest // 1000 - 1))  # before the last row: the watermark may never pass that
        yield pd.DataFrame([], columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        places = sorted(int(r[0]) for r in self.sizes.keys())
        begun = [p for p in places if p * self.step <= passed]
        start, held, keys, coarsened = self.window.get() if self.window.exists() else (None, 0, 0, 0)
        states = {r[0][0]: [r[1][0], json.loads(r[1][1])] for r in self.kept.iterator()} if begun or start is not None else {}
        out, touched, later = [], set(), []

        def close() -> None:
            for name, (number, reps) in states.items():
                for k, (_, _, _, payload) in enumerate(reps, 1):
                    out.append((key[0], start, name, k, number - (min(number, self.most) - 1) if k == 1 else 1, number, held, keys, coarsened, payload))
            states.clear()
            touched.clear()
            self.kept.clear()

        for place in begun:
            waiting = self._take(place)
            rest = [r for r in waiting if r[0] > passed]
            if rest:
                later += rest
                self._wait(rest)
            for ts, event_id, risk, name, payload in sorted(r for r in waiting if r[0] <= passed):
                if start is None or ts > start + self.step or held >= self.events:
                    if start is not None:
                        close()
                    start, held, keys, coarsened = ts, 0, 0, 0
                held += 1
                if name not in states and keys >= self.states - 1:
                    name = "__overflow__"
                if name == "__overflow__":
                    coarsened += 1
                if name not in states:
                    states[name] = [0, []]
                    keys += name != "__overflow__"
                state, mine = states[name], [-risk, ts, event_id, payload]
                state[0] += 1
                if len(state[1]) < self.most or mine < state[1][-1]:
                    state[1] = sorted([*state[1], mine])[: self.most]
                touched.add(name)
            if out:
                yield pd.DataFrame(out, columns=NAMES)
                out.clear()
        after = [p for p in places if p * self.step > passed]
        if later or after:  # a slice that has not begun is asked for at its beginning
            self.handle.registerTimer((max(r[0] for r in later) if later else after[0] * self.step) // 1000 + 1)
        if start is not None and start + self.step < passed:
            close()
            self.window.clear()
        elif start is not None:
            for name in touched:
                self.kept.updateValue((name,), (states[name][0], json.dumps(states[name][1])))
            self.window.update((start, held, keys, coarsened))
            self.handle.registerTimer((start + self.step) // 1000 + 1)
        yield pd.DataFrame(out, columns=NAMES)


def state_windows(scored: DataFrame, stream: Column | None = None, seconds: int = 300, events: int = 20_000, states: int = 2000, most: int = 3) -> DataFrame:
    """Representatives of the states of closed windows, from a stream of actionable events with a watermark on event_ts.

    (stream, window_start, state_key, rep, weight, event_count, window_events, window_states, coarsened, payload): what the batch stages `anchored_windows`, `overflow` and `representatives` give; payload is the event.
    A window closes when the watermark passes its end, or with the row that opens the next one. stream: what windows are kept for (one stream by default, as in the batch stage);
    each of its values is folded in one task's state, which holds the rows inside the watermark's delay and at most `states` keyed states."""
    _provider(scored)
    keyed = windows.state_keys(scored).withColumn("state_key", F.concat_ws("|", *[f"k_{k}" for k in windows.KEY])).drop(*[f"k_{k}" for k in windows.KEY])
    columns = [c for c in scored.columns if c != "event_ts"]
    rows = keyed.select(
        (F.lit("all") if stream is None else F.coalesce(stream.cast("string"), F.lit(""))).alias("stream"), "event_ts", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"),
        F.col("event_id").cast("string").alias("event_id"), F.coalesce("risk_score", F.lit(0)).cast("int").alias("risk_score"), "state_key", F.to_json(F.struct(F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"), *columns)).alias("payload"),
    )
    return rows.groupBy("stream").transformWithStateInPandas(Windows(seconds, events, states, most), REPRESENTATIVE, "Append", "EventTime")


def representatives(closed: DataFrame, schema) -> DataFrame:
    """The events that the rows of `state_windows` carry, with window_start, state_key, rep and weight. schema: that of the scored rows."""
    from pyspark.sql.types import LongType, StructField, StructType

    kept = StructType([StructField("us", LongType()), *(f for f in schema if f.name != "event_ts")])
    rows = closed.withColumn("e", F.from_json("payload", kept))
    return rows.select(F.timestamp_micros("e.us").alias("event_ts"), *[F.col(f"e.`{f.name}`") for f in schema if f.name != "event_ts"], F.timestamp_micros("window_start").alias("window_start"), "stream", "state_key", "rep", "weight")


def incidents_of(reps: DataFrame, seconds: int, judge=None, events_each: int = 6, window: str = "window_start") -> DataFrame:
    """The incidents of windows' representatives, as the batch stage `incidents` has them."""
    scratch = Scratch(reps.sparkSession, "stream")
    reps = scratch.keep(reps, "reps")
    found, pairs = correlate.incident_members(reps, window, seconds, judge, scratch)
    members = scratch.keep(correlate.attribute_services(reps.join(found, "event_id")), "members")
    return correlate.rollup(members, pairs, weight="weight").join(correlate.explicit_trace(members), "incident").join(correlate.representative_events(members, events_each), "incident", "left")


def to_incidents(scored: DataFrame, store: IncidentStore, checkpoint: str, seconds: int = 300, judge=None, stream: Column | None = None, trigger: dict | None = None, **limits):
    """Start a query that turns a stream of actionable events into incidents in the store: the windows that close in a micro-batch are correlated, and upserted under the batch's number.

    The query's name in `spark.streams` carries the counts of `window_counters` as observed metrics."""
    closed = state_windows(scored, stream, seconds, **limits).observe("windows", *window_counters())

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        reps = representatives(batch, scored.schema).withColumn("window", F.struct("stream", "window_start"))
        made = incidents_of(reps.drop("stream"), seconds, judge, window="window")
        store.upsert(made, number)

    writer = closed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def window_counters() -> list[Column]:
    """Counts over the rows of closed windows: windows, their events, states and coarsened events. Each window counts with its first row alone."""
    first = F.col("rep") == 1
    return [
        F.coalesce(F.sum(F.when(first, F.col("event_count"))), F.lit(0)).alias("stream_aggregated_events"), F.count(F.lit(1)).alias("stream_represented_events"),
        F.coalesce(F.max("window_events"), F.lit(0)).alias("max_active_window_events"), F.coalesce(F.max("window_states"), F.lit(0)).alias("max_active_incident_states"),
        F.coalesce(F.sum(F.when(first & (F.col("state_key") == "__overflow__"), F.col("event_count"))), F.lit(0)).alias("stream_coarsened_events"),
    ]
