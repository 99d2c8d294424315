"""Ordered folds per key as streams with their batch twins, and event-time operators.

On a stream a key's rows are folded in order by a small step function; typed state is carried between batches, and timers end
state that no longer matters. In batch T1 to T3 are windows over slices of time and joins; W4, whose next step depends
on the last decision, walks sorted rows with the same step, a row a service and interval."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.windows import change_feed, failures_in_row, running_ewma, running_max, running_sum
from tidemark.sources.changes import upsert_batch
from tidemark.staging import made_since, mark, release, written

# A step takes the state (a tuple of numbers or texts) and a row, and returns the new state and an output row, or None for no row.
Step = Callable[[tuple, object], tuple[tuple, tuple | None]]


def fold(df: DataFrame, key: str, order: list[str], step: Step, start: tuple, schema: str) -> DataFrame:
    """The outputs of step over each key's rows in order. schema: that of the outputs, key first.

    Spark sorts the rows, and may spill; Python holds a batch and the state of the key that it is at. A key's rows are
    still walked by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, begun = None, start, False
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                now = getattr(row, key)
                now = None if pd.isna(now) else now
                if not begun or now != own:
                    own, state, begun = now, start, True
                state, made = step(state, row)
                if made is not None:
                    out.append((now, *made))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return df.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order]).mapInPandas(run, schema)


#: Event times are moved by so many seconds: a watermark begins at 0, and a row must be later than it.
AHEAD = 86_400


def timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """df with a watermark on the time `at`, in seconds from 0 up."""
    return df.withColumn("event_time_", F.timestamp_micros(((F.col(at) + AHEAD) * 1_000_000).cast("long"))).withWatermark("event_time_", late)


def stateful(spark: SparkSession) -> None:
    """Typed state needs the state store on disk, which also keeps state out of the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold(StatefulProcessor):
    """Folds each key's rows in order of `order`, whose first column is a number.

    Rows come as an iterator of frames. One frame is sorted and folded. More than one are first cut into slices of the first order
    column and kept in a map in the state store, and slices are then folded in order: Python holds a frame or a slice,
    however many rows a key has in a batch. A slice is as long as a quarter of the first frame, so it follows the rate."""

    def __init__(self, names: list[str], order: list[str], step: Step, start: tuple, state_schema: str, ttl: float | None):
        self.names, self.order, self.step, self.start, self.state_schema, self.ttl = names, order, step, start, state_schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.held = handle.getMapState("held", "slice long, part int", "rows binary")
        self.ends = handle.getValueState("ends", "at long")

    def sorted_frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(rows)
        second = next(rows, None)
        if second is None:
            yield first.sort_values(self.order, kind="stable")
            return
        at = first[self.order[0]].astype(float)
        width = max((at.max() - at.min()) / 4, 1e-6)
        keys: list[tuple[int, int]] = []
        for part, frame in enumerate(chain([first, second], rows)):
            for where, cut in frame.groupby(np.floor(frame[self.order[0]].astype(float) / width).astype("int64")):
                sink = io.BytesIO()
                table = pa.Table.from_pandas(cut, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                keys.append((int(where), part))
                self.held.updateValue(keys[-1], (sink.getvalue(),))
        keys.sort()
        for where in dict.fromkeys(k[0] for k in keys):
            parts = []
            for key in (k for k in keys if k[0] == where):
                parts.append(pa.ipc.open_stream(self.held.getValue(key)[0]).read_pandas())
                self.held.removeKey(key)
            yield pd.concat(parts).sort_values(self.order, kind="stable")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else self.start
        newest = None
        for frame in self.sorted_frames(rows):
            out = []
            for row in frame.itertuples(index=False):
                now, made = self.step(now, row)
                if made is not None:
                    out.append((key[0], *made))
            newest = float(frame[self.order[0]].max())
            if out:
                yield pd.DataFrame(out, columns=self.names)
        self.state.update(tuple(now))
        if self.ttl is not None and newest is not None:
            self.end_at(newest + self.ttl, timerValues)

    def end_at(self, at: float, timerValues) -> None:
        """The key's timer, instead of the one it had."""
        before = self.ends.get()[0] if self.ends.exists() else None
        ends = max(int((at + AHEAD) * 1000), timerValues.getCurrentWatermarkInMs() + 1, before or 0)
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ends)
        self.ends.update((ends,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.ended(key)
        self.state.clear()
        self.ends.clear()
        yield from out

    def ended(self, key) -> list[pd.DataFrame]:
        """What a key's end tells."""
        return []

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str, order: list[str], step: Step, start: tuple, schema: str, state_schema: str, ttl: float | None = None, late: str = "10 minutes", kind: type[Fold] = Fold) -> DataFrame:
    """The same on a stream: the state of a key is kept between batches; rows that come late are folded when they come.

    ttl: seconds of event time (order[0], in seconds) after a key's last row at which its state goes; the watermark, `late`
    behind the newest row, tells the time, and rows that come later than that are dropped. Without ttl state is kept for good."""
    names = [c.split()[0] for c in schema.split(", ")]
    stateful(df.sparkSession)
    processor = kind(names, order, step, start, state_schema, ttl)
    rows = df if ttl is None else timed(df, order[0], late)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none" if ttl is None else "eventTime")


def limit_step(n: int = 60, window: float = 60.0) -> Step:
    """N tokens, of which the first call takes one; they are all back once `window` seconds have passed since the last refill."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        left, since = state
        if left < 0 or row.at - since >= window:
            left, since = n, row.at
        ok = left > 0
        return (left - ok, since), (row.event_id, bool(ok))

    return step


LIMIT_SCHEMA = "client string, event_id long, allowed boolean"


def next_spots(spots: DataFrame, window: float) -> DataFrame:
    """(client, at, next): of each client's times the first one that is `window` or more later, or null; by slices of time."""
    slices = F.floor(F.col("t") / max(60 * window, 1.0)).alias("slice_")
    kinds = F.array(F.struct(F.col("at").alias("t"), F.lit(1).alias("spot")), F.struct((F.col("at") + window).alias("t"), F.lit(0).alias("spot")))
    rows = spots.select("client", "at", F.explode(kinds).alias("x")).select("client", "at", "x.t", "x.spot").withColumn("slice_", slices)
    here = Window.partitionBy("client", "slice_").orderBy("t", "spot").rowsBetween(0, Window.unboundedFollowing)
    is_spot = F.when(F.col("spot") == 1, F.col("t"))
    later = Window.partitionBy("client").orderBy("slice_").rowsBetween(1, Window.unboundedFollowing)
    after = rows.groupBy("client", "slice_").agg(F.min(is_spot).alias("first_")).select("client", "slice_", F.min("first_").over(later).alias("after_"))
    found = rows.withColumn("here_", F.min(is_spot).over(here)).where("spot = 0")
    return found.join(after, ["client", "slice_"]).select("client", "at", F.coalesce("here_", "after_").alias("next"))


def refills(requests: DataFrame, window: float) -> DataFrame:
    """(client, at): when each client's tokens come back: at its first call, and then at the first call `window` or more after
    the last time.

    Which calls these are is found by pointer doubling: each time points to the next possible one; marked ones mark where they
    point, and pointers double in length, so there are as many rounds as the logarithm of the longest chain."""
    spark = requests.sparkSession
    hops = written(next_spots(requests.select("client", F.col("at").cast("double").alias("at")).distinct(), window), "refill-hops")
    marks = written(hops.groupBy("client").agg(F.min("at").alias("at")), "refill-marks")
    n = marks.count()
    while True:
        begun = mark() - 2
        further = written(marks.join(hops.where("next IS NOT NULL"), ["client", "at"]).select("client", F.col("next").alias("at")).union(marks), "refill-marks")
        twice = hops.select("client", "at", F.col("next").alias("via")).join(hops.select("client", F.col("at").alias("via"), "next"), ["client", "via"])
        hops, marks = written(twice.select("client", "at", "next"), "refill-hops"), further
        release(spark, made_since(begun)[:2])
        # a chain's marks grow by its own number each round, until its end
        if (now := marks.count()) == n:
            return marks
        n = now


def rate_limit(requests: DataFrame, n: int = 60, window: float = 60.0) -> DataFrame:
    """T2 as a batch: (client, event_id, at in seconds) -> whether each call is allowed: n calls of each refill are.

    No task walks a client's history: refills are marked by pointer doubling, calls look theirs up by slices of time, and are
    numbered within it by slices too."""
    calls = requests.select("client", "event_id", F.col("at").cast("double").alias("at"))
    micros = (F.col("at") * 1_000_000).cast("long")
    marked = calls.join(refills(calls, window).withColumn("mark_", F.col("at")), ["client", "at"], "left")
    since = running_max(marked, ["client"], ["at", "event_id"], F.col("mark_"), "since_", micros)
    counted = running_sum(since, ["client", "since_"], ["at", "event_id"], F.lit(1), "k_", micros, max(1, int(window / 4)))
    return counted.select("client", "event_id", (F.col("k_") <= n).alias("allowed"))


def stream_rate_limit(requests: DataFrame, n: int = 60, ttl: float | None = 600.0) -> DataFrame:
    """The same on a stream. A client without calls for ttl seconds is forgotten; as its tokens would be back by then, no
    answer changes."""
    return fold_stream(requests, "client", ["at", "event_id"], limit_step(n), (-1, 0.0), LIMIT_SCHEMA, "left int, since double", ttl)


#: Thresholds of a service, as S11 reads them, with their defaults.
SCALE_CONFIG = {"min_replicas": 1, "max_replicas": 5, "cpu_up": 65.0, "cpu_down": 20.0, "interval_sec": 8}


def scale_step(up_after: int = 2, down_after: int = 4, up_rest: float = 10.0, down_rest: float = 15.0) -> Step:
    """Act after so many ticks in a row, unless the last change is too recent; a blocked tick keeps its streak. Thresholds are
    the row's own."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        replicas, streak, last = state
        busy = (row.effective >= row.cpu_up or row.max_cpu >= row.cpu_up) and replicas < row.max_replicas
        idle = row.max_cpu <= row.cpu_down and row.avg_cpu <= row.cpu_down and replicas > row.min_replicas
        streak = (max(streak, 0) + 1) if busy else (min(streak, 0) - 1) if idle else 0
        action = 0
        if streak >= up_after and row.tick - last >= up_rest:
            action = 1
        elif streak <= -down_after and row.tick - last >= down_rest:
            action = -1
        if action:
            replicas, streak, last = replicas + action, 0, row.tick
        return (replicas, streak, last), (row.tick, action, replicas)

    return step


SCALE_SCHEMA = "service string, tick long, action int, replicas int"
SCALE_START = (1, 0, -1_000_000)


def configured(rows: DataFrame, config: DataFrame | None, **defaults) -> DataFrame:
    """rows of services with their thresholds: those of the config table (S11: service and columns of SCALE_CONFIG), only whose services
    are scaled; without a table everybody has the defaults."""
    own = SCALE_CONFIG | defaults
    if config is None:
        return rows.withColumns({c: F.lit(v) for c, v in own.items() if c not in rows.columns})
    return rows.join(config.select("service", *[F.coalesce(c, F.lit(v)).alias(c) if c in config.columns else F.lit(v).alias(c) for c, v in own.items()]), "service")


def measured(rows, keys: list):
    """A1 of groups of samples: average, maximum and effective load; with their thresholds, which are the group's own."""
    held = [F.first(c).alias(c) for c in SCALE_CONFIG]
    out = rows.groupBy(*keys).agg(F.avg("cpu").alias("avg_cpu"), F.max("cpu").alias("max_cpu"), *held)
    return out.withColumn("effective", F.greatest("avg_cpu", F.col("max_cpu") * 0.95))


def interval_metrics(samples: DataFrame, seconds: int = 8, config: DataFrame | None = None) -> DataFrame:
    """A1 for each service and interval, with the service's thresholds; tick is the interval's start in seconds. With a config table each
    service has its own interval."""
    rows = configured(samples, config, interval_sec=seconds)
    every = F.col("interval_sec")
    return measured(rows, ["service", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / every) * every).alias("tick")])


def scale_decisions(metrics: DataFrame, config: DataFrame | None = None, up_after: int = 2, down_after: int = 4, up_rest: float = 10.0, down_rest: float = 15.0, **defaults) -> DataFrame:
    """Decisions tick by tick; replicas feed back into later ticks. Each service has the thresholds of its row of config, or those that
    its metrics carry, or the defaults. A tick without a valid sample ends a streak."""
    rows = configured(metrics.drop(*defaults) if config is None else metrics.drop(*SCALE_CONFIG), config, **defaults)
    return fold(rows, "service", ["tick"], scale_step(up_after, down_after, up_rest, down_rest), SCALE_START, SCALE_SCHEMA)


def stream_scale_decisions(metrics: DataFrame, config: DataFrame | None = None, up_after: int = 2, down_after: int = 4, up_rest: float = 10.0, down_rest: float = 15.0, **defaults) -> DataFrame:
    """The same on a stream of interval metrics; config is a table that doesn't stream."""
    rows = configured(metrics.drop(*defaults) if config is None else metrics.drop(*SCALE_CONFIG), config, **defaults)
    return fold_stream(rows, "service", ["tick"], scale_step(up_after, down_after, up_rest, down_rest), SCALE_START, SCALE_SCHEMA, "replicas int, streak int, last long")


def stream_scaling(samples: DataFrame, config: DataFrame | None = None, seconds: int = 8, late: str = "10 minutes", **options) -> DataFrame:
    """T4: from a stream of samples (service, ts, cpu) to decisions in one query: each service's samples are averaged over windows of its
    interval, as the watermark closes them, and the decisions' state follows. Thresholds come from the config table, which
    each batch joins anew. Samples that come `late` behind the newest one are dropped.

    A window's length is a constant of its aggregation, so there is one for each different interval of the table."""
    rows = configured(samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), config, **({"interval_sec": seconds} | {k: v for k, v in options.items() if k in SCALE_CONFIG}))
    lengths = [seconds] if config is None else [r[0] for r in config.select(F.coalesce("interval_sec", F.lit(seconds))).distinct().orderBy(F.col("interval_sec")).collect()]
    parts = [measured(rows.where(F.col("interval_sec") == n), ["service", F.window("ts", f"{n} seconds").alias("window")]) for n in lengths]
    metrics = parts[0]
    for other in parts[1:]:
        metrics = metrics.unionByName(other)
    ticks = metrics.withColumn("tick", F.unix_seconds("window.start")).drop("window")
    return stream_scale_decisions(ticks, **{k: v for k, v in options.items() if k not in SCALE_CONFIG})


def feed_step(state: tuple, row) -> tuple[tuple, tuple | None]:
    """A row if status or percent differ from the last; nothing after completed or error."""
    ended, status, percent = state
    now = None if pd.isna(row.percent) else row.percent
    if ended or (status == row.status and percent == now):
        return state, None
    return (int(row.status in ("completed", "error")), row.status, now), (row.seq, row.status, now)


FEED_SCHEMA = "job_id string, seq int, status string, percent double"
FEED_START = (0, "", -1.0)


def change_feed_fold(events: DataFrame) -> DataFrame:
    """T1 as a batch: W2's feed of changes, by windows."""
    return change_feed(events, "job_id", ["seq"]).select("job_id", "seq", "status", "percent")


def stream_change_feed(events: DataFrame) -> DataFrame:
    """The live feed of each job's changes."""
    return fold_stream(events, "job_id", ["seq"], feed_step, FEED_START, FEED_SCHEMA, "ended int, status string, percent double")


#: Averages are told with so many decimals: a walk and a sum of slices differ in the last digits of a double.
PLACES = 9


def health_step(alpha: float = 0.2, failures: int = 3, seconds: float = 15.0, penalty: float = 0.0) -> Step:
    """Moving average, failures in a row, and until when the circuit is open; a success leaves that as it is. A failure counts
    `penalty` ms more."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        ewma, in_row, until = state
        failed = row.status_code >= 500
        ewma = (1 - alpha) * ewma + alpha * (row.duration_ms + (penalty if failed else 0.0))
        in_row = in_row + 1 if failed else 0
        until = row.at + seconds if in_row >= failures else until
        return (ewma, in_row, until), (row.event_id, round(ewma, PLACES), in_row, until)

    return step


HEALTH_SCHEMA = "node int, event_id long, ewma double, in_row int, open_until double"
HEALTH_START = (15.0, 0, 0.0)


def node_health(requests: DataFrame, failures: int = 3, seconds: float = 15.0, penalty: float = 0.0) -> DataFrame:
    """T3 as a batch, by windows over slices of time: no task walks a node's history."""
    at, order = (F.col("at") * 1_000_000).cast("long"), ["at", "event_id"]
    failed = F.col("status_code") >= 500
    rows = running_ewma(requests, "node", order, F.col("duration_ms") + F.when(failed, penalty).otherwise(0.0), at)
    rows = failures_in_row(rows, "node", order, failed, at)
    # later openings end later, so the last one is the largest
    rows = running_max(rows, ["node"], order, F.when(F.col("in_row") >= failures, F.col("at") + seconds), "until_", at)
    return rows.select("node", "event_id", F.round("ewma", PLACES).alias("ewma"), F.col("in_row").cast("int").alias("in_row"), F.coalesce("until_", F.lit(0.0)).alias("open_until"))


def stream_node_health(requests: DataFrame, penalty: float = 0.0) -> DataFrame:
    return fold_stream(requests, "node", ["at", "event_id"], health_step(penalty=penalty), HEALTH_START, HEALTH_SCHEMA, "ewma double, in_row int, open_until double")


def live_state(events: DataFrame, now: Column, key: str = "job_id", ts: str = "ts", ttl: int = 7200) -> DataFrame:
    """T5: each key's last row, if it isn't older than ttl seconds."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[c for c in (ts, "event_id") if c in rest])).alias("s")).select(key, "s.*")
    return last.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) < ttl * 1_000_000)


STATE_SCHEMA = "job_id string, status string, percent double, expires_at double, live boolean"


def state_step(state: tuple, row) -> tuple[tuple, None]:
    """T5: the last row of a job; an older one is left out."""
    if row.at < state[0]:
        return state, None
    return (float(row.at), row.status, None if pd.isna(row.percent) else float(row.percent)), None


class LiveState(Fold):
    """T5: after its rows a key's state, and once more when it ends."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else self.start
        # the largest time wins, whatever the order, so frames needn't be sorted together
        for frame in rows:
            for row in frame.sort_values(self.order, kind="stable").itertuples(index=False):
                now, _ = self.step(now, row)
        self.state.update(now)
        self.end_at(now[0] + self.ttl, timerValues)
        yield pd.DataFrame([(key[0], now[1], now[2], now[0] + self.ttl, True)], columns=self.names)

    def ended(self, key) -> list[pd.DataFrame]:
        at, status, percent = self.state.get()
        return [pd.DataFrame([(key[0], status, percent, at + self.ttl, False)], columns=self.names)]


def stream_state(events: DataFrame, ttl: float = 7200.0, late: str = "10 minutes") -> DataFrame:
    """T5 on a stream of events (job_id, at in seconds, status, percent): a row with live true whenever a job's last state changes, and one with
    live false when it has not changed for ttl seconds of event time and is dropped. An event older than the state is left out."""
    return fold_stream(events, "job_id", ["at"], state_step, (float("-inf"), None, None), STATE_SCHEMA, "at double, status string, percent double", ttl, late, LiveState)


def idle_step(gap: float) -> Step:
    """A row if the last request ended at least gap seconds before this one begins; overlapping requests end with the last of them."""

    def step(state: tuple, row) -> tuple[tuple, tuple | None]:
        last = state[0]
        ends = row.at + max(float(row.seconds), 0.0) if hasattr(row, "seconds") else row.at
        return (max(last, ends),), (last, row.at, row.at - last) if last >= 0 and row.at - last >= gap else None

    return step


def stream_idle(requests: DataFrame, gap: float = 600.0) -> DataFrame:
    """T6 on a stream of requests (node, at in seconds, and how many seconds they last): stretches of at least gap seconds in which no
    request was active, told when they end."""
    return fold_stream(requests, "node", ["at"], idle_step(gap), (-1.0,), "node int, from double, to double, seconds double", "last double")


def idle_sessions(requests: DataFrame, gap: int = 600, key: str = "node", value: str | None = "duration_ms") -> DataFrame:
    """Stretches of at least `gap` seconds without an active request, between two sessions of a worker. A request is active from its
    time on for `value` milliseconds (None: for an instant).

    A session window's gap is a row's own length and `gap`, less a microsecond, as what begins at a session's end belongs to it: so
    sessions are merged as long as anything is active or was so less than `gap` ago."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    # whole microseconds: a session ends with its longest request
    ends = start + (F.lit(0) if value is None else (F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)) * 1000).cast("long"))
    rows = requests.select(key, F.timestamp_micros(start).alias("t"), ends.alias("ends_"))
    length = F.concat((F.col("ends_") - F.unix_micros("t") + gap * 1_000_000 - 1).cast("string"), F.lit(" microseconds"))
    sessions = rows.groupBy(key, F.session_window("t", length).alias("s")).agg(F.max("ends_").alias("last"))
    w = Window.partitionBy(key).orderBy("s.start")
    idle = sessions.select(key, F.timestamp_micros(F.lag("last").over(w)).alias("from"), F.col("s.start").alias("to"))
    return idle.where(F.col("from").isNotNull()).withColumn("seconds", (F.unix_micros("to") - F.unix_micros("from")) / 1e6)


def upsert_sessions(logins: DataFrame) -> DataFrame:
    """Of logins (token, ts, agent, ip) one session a token: active, an hour from the last login, with the last agent and address known."""
    order = F.struct("ts")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return logins.groupBy("token").agg(F.min("ts").alias("created"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), known("agent"), known("ip"), F.lit("active").alias("status"))


def upsert_users(logins: DataFrame) -> DataFrame:
    """Of logins (uid, ts, name, photo) one user an id: created at the first, with the last name and photo that are there."""
    known = lambda c: F.max_by(c, F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col("ts"))).alias(c)
    return logins.groupBy("uid").agg(F.min("ts").alias("created"), F.max("ts").alias("last_login"), known("name"), known("photo"))


def fold_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of several batches as one a token: known ones live on with their creation, and with their agent and address where later
    ones have none."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order_"))).alias(c)
    return rows.groupBy("token").agg(F.min("created").alias("created"), F.max("expires_at").alias("expires_at"), last("agent"), last("ip"), last("status"))


def fold_users(rows: DataFrame) -> DataFrame:
    """Users of several batches as one an id."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order_"))).alias(c)
    return rows.groupBy("uid").agg(F.min("created").alias("created"), F.max("last_login").alias("last_login"), last("name"), last("photo"))


def stream_sessions(logins: DataFrame, path: str):
    """T7 on a stream: a writer that adds each batch's sessions to the table of changes at path; read it with
    read_changes(spark, path, fold_sessions). Start it with a checkpoint; a batch that is done twice changes nothing the second time."""
    return logins.writeStream.foreachBatch(lambda batch, number: upsert_batch(upsert_sessions(batch), path, number, fold_sessions))


def stream_users(logins: DataFrame, path: str):
    """T8 on a stream, as stream_sessions; read it with read_changes(spark, path, fold_users)."""
    return logins.writeStream.foreachBatch(lambda batch, number: upsert_batch(upsert_users(batch), path, number, fold_users))


def dedupe_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, if its copies come within the watermark's delay; on a batch, each event once."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
