"""Event-time streaming versions of the core counts.

Each operator takes a *streaming* DataFrame with the ``events`` schema and
returns a streaming DataFrame. Two drivers run one into a parquet sink under
the shared checkpoint folder and return the sink as a batch DataFrame:

* :func:`replay` for a table at rest. Which rows a watermark calls late
  depends on how the rows are cut into micro-batches, so the rows are fed in
  event-time order (one micro-batch per time slice, one slice if the table is
  small): none is late, and the answer depends on neither the files nor the
  number of batches.
* :func:`run_live` for files that arrive. Rows behind the delay are written
  to a side table with their count instead of vanishing: kept + late = input.

:func:`run_available_now` is the plain run under both. Event times are NTZ on disk; watermarks need TIMESTAMP, so
``event_time`` is the cast column (session zone UTC keeps wall-clock values).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefn import duration_us, micros, to_event_time
from ..session import checkpoint_dir, delete_path, scratch_path
from ..sources.tables import SCHEMAS, read_table


def _interval(spec: str) -> str:
    us = duration_us(spec)
    return f"{us // 1_000_000} seconds" if us % 1_000_000 == 0 else f"{us} microseconds"


#: bytes of input per micro-batch of a replay
SLICE_BYTES = 64 << 30
#: files that a slice is written to
FILES_PER_SLICE = 64


def read_event_stream(spark: SparkSession, directory: str, glob: str | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of ``events`` parquet files in ``directory``. By
    default a run takes what is there as one micro-batch, as a batch job
    would; ``max_files_per_trigger`` cuts it up, and with it what counts as
    late (use :func:`replay` or :func:`run_live` where that matters)."""
    r = spark.readStream.schema(SCHEMAS["events"])
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(directory)


def read_table_stream(spark: SparkSession, base: str, name: str = "events",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the table ``<base>/<name>.parquet`` whether it is a directory of
    part files (streamed directly) or a single file (its folder is streamed
    with a file-name filter; the file source only takes directories)."""
    path = f"{base.rstrip('/')}/{name}.parquet"
    files = spark.read.parquet(path).inputFiles()
    if any(f"/{name}.parquet/" in f for f in files):
        return read_event_stream(spark, path, max_files_per_trigger=max_files_per_trigger)
    return read_event_stream(spark, base, glob=f"{name}.parquet",
                             max_files_per_trigger=max_files_per_trigger)


def replay(spark: SparkSession, base: str, build: Callable[[DataFrame], DataFrame], name: str,
           table: str = "events", slices: int | None = None) -> DataFrame:
    """Run ``build(stream)`` over the table at rest, in event-time order.

    With one slice the table is streamed as it is, in one micro-batch. With
    more, the table is written once, cut at quantiles of its times into one
    folder per slice; the folders are then moved one by one to where the stream
    looks, each run as one micro-batch (same query checkpoint, same sink). So
    besides a look at its times the table is read once, however many slices.
    ``slices`` defaults to one per ``SLICE_BYTES`` of files. Rows without a time
    have no place in an order: the first slice has them, and the operators drop
    them as the batch ones do."""
    path = f"{base.rstrip('/')}/{table}.parquet"
    data = read_table(spark, base, table)
    if slices is None:
        slices = max(1, -(-_n_bytes(spark, path) // SLICE_BYTES))
    if slices == 1:
        return run_available_now(spark, build(read_table_stream(spark, base, table)), name)
    us = data.select(micros("ts").cast("double").alias("t")).where(F.col("t").isNotNull())
    cuts = sorted({int(c) for c in us.approxQuantile("t", [k / slices for k in range(1, slices)], 0.1 / slices)})
    staged, landing, sink, ckpt = (scratch_path(spark, f"{name}-{x}") for x in ("staged", "landing", "sink", "ckpt"))
    before = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (c <= micros("ts")).cast("int")) if cuts else F.lit(0)
    sliced = data.withColumn("slice", F.coalesce(before, F.lit(0)))
    # a slice is many tasks and files, each task has few slices
    sliced = sliced.repartition(F.col("slice"), F.pmod(F.xxhash64(*data.columns), F.lit(FILES_PER_SLICE)))
    sliced.write.partitionBy("slice").parquet(staged)
    out = None
    for k in range(len(cuts) + 1):
        if _moved(spark, f"{staged}/slice={k}", f"{landing}/slice={k}") or out is None:
            stream = build(read_event_stream(spark, f"{landing}/slice=*"))
            out = run_available_now(spark, stream, name, sink=sink, checkpoint=ckpt)
    delete_path(spark, staged)
    delete_path(spark, landing)
    return out


def _moved(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder if it is there."""
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    return bool(fs.exists(at)) and bool(fs.rename(at, to))


def _n_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def run_live(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], name: str,
             delay: str, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run ``build(stream)`` over what has arrived: (sink, late rows).

    Each micro-batch of ``stream`` is first split: a row more than ``delay``
    behind the latest time of the batches before it is late and goes to the
    side table; the others are landed and run. The latest time is kept per
    batch number and every write of a batch replaces its own folder, so a
    repeated batch changes nothing. With the same ``home`` a rerun resumes."""
    home = home or scratch_path(spark, name)
    landing, late = f"{home}/landing", f"{home}/late"
    schema = stream.schema
    delay_us = duration_us(delay)

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_t", micros("ts"))
        seen = _read_or_empty(spark, f"{home}/latest", "n bigint, t bigint").where(F.col("n") < number)
        latest = seen.agg(F.max("t")).first()[0]
        is_late = F.lit(False) if latest is None else F.coalesce(F.col("_t") < F.lit(latest - delay_us), F.lit(False))
        batch.where(is_late).drop("_t").write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.where(~is_late).drop("_t").write.mode("overwrite").parquet(f"{landing}/batch={number}")
        batch.agg(F.lit(number).cast("bigint").alias("n"), F.max("_t").alias("t")).write.mode("overwrite").parquet(f"{home}/latest/batch={number}")
        run_available_now(spark, build(read_event_stream(spark, f"{landing}/batch=*").select(*schema.fieldNames())),
                          name, sink=f"{home}/sink", checkpoint=f"{home}/run")

    q = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{home}/split").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    built = build(read_event_stream(spark, landing))
    return (_read_or_empty(spark, f"{home}/sink", built.schema),
            _read_or_empty(spark, late, schema).select(*schema.fieldNames()))


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def with_event_time(stream: DataFrame, delay: str) -> DataFrame:
    return (stream.withColumn("event_time", to_event_time("ts"))
                  .withWatermark("event_time", _interval(delay)))


def stream_window_counts(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """P30. Tumbling event-time windows per event type (count, value sum).
    Append mode emits a window once the watermark passes its end. A row is
    dropped as late when it is older than the watermark the previous
    micro-batch ended with (Spark's late-event watermark)."""
    s = with_event_time(stream, delay)
    return (s.groupBy(F.window("event_time", _interval(width)).alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_sum"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     "event_type", "n", "value_sum"))


def stream_sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """P30. Per-user event-time sessions (``session_window``): start, end
    (last event + gap), event count."""
    s = with_event_time(stream, delay)
    return (s.groupBy("user_id", F.session_window("event_time", _interval(gap)).alias("s"))
             .agg(F.count(F.lit(1)).alias("n_events"))
             .select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                     F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events"))


def stream_dedup(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """P31. First arrival per key; a repeat arriving within ``delay`` (event
    time) of the first is dropped, state is released behind the watermark."""
    s = with_event_time(stream, delay)
    return s.dropDuplicatesWithinWatermark(keys).drop("event_time")


USER_STATE_OUT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("as_of", T.TimestampType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("n_purchases", T.LongType()),
    T.StructField("last_event", T.TimestampType()),
    T.StructField("last_purchase", T.TimestampType()),
    T.StructField("expired", T.BooleanType()),
])
USER_STATE = T.StructType([
    T.StructField("n_events", T.LongType()),
    T.StructField("n_purchases", T.LongType()),
    T.StructField("last_event", T.TimestampType()),
    T.StructField("last_purchase", T.TimestampType()),
])


#: events of a user with no gap above the ttl between them; times in microseconds
SPELLS = "user_id bigint, n bigint, p bigint, first bigint, last bigint, last_p bigint"
#: stands for no purchase
_NEVER = int(np.iinfo(np.int64).min)
#: spells a task holds before it passes them on
HELD = 50_000


def _merged(user: np.ndarray, n: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray, last_p: np.ndarray,
            ttl_us: int) -> tuple[np.ndarray, ...]:
    """Spells in any order, overlapping ones too, as the spells they make up
    together, by user and time. Parts of a spell have no inner gap above the
    ttl, so neither has what they make up: the order of merging changes nothing."""
    order = np.lexsort((first, user))
    user, n, p, first, last, last_p = (x[order] for x in (user, n, p, first, last, last_p))
    reach = pd.Series(last).groupby(user).cummax().to_numpy()
    new = np.ones(len(user), bool)
    new[1:] = (user[1:] != user[:-1]) | (first[1:] - reach[:-1] > ttl_us)
    at = np.flatnonzero(new)
    return (user[at], np.add.reduceat(n, at), np.add.reduceat(p, at), first[at],
            np.maximum.reduceat(last, at), np.maximum.reduceat(last_p, at))


def _spells_of(ttl_us: int) -> Callable:
    """From events (user_id, t, hit) to spells, merged within the task, so that
    a user's part of a task is as many rows as it has spells, not events."""
    def rows(held: tuple[np.ndarray, ...], no_user: bool) -> pa.RecordBatch:
        user, n, p, first, last, last_p = held
        return pa.RecordBatch.from_arrays(
            [pa.array(user, mask=np.full(len(user), no_user)), *map(pa.array, (n, p, first, last, last_p))], names=["user_id", "n", "p", "first", "last", "last_p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[np.ndarray, ...]] = {}
        for b in batches:
            for no_user in (False, True):  # null is a user of its own
                own = b.filter(b.column(0).is_null() if no_user else b.column(0).is_valid())
                if not own.num_rows:
                    continue
                user = own.column(0).fill_null(0).to_numpy()
                t, hit = own.column(1).to_numpy(), own.column(2).to_numpy(zero_copy_only=False)
                new = (user, np.ones(len(t), np.int64), hit.astype(np.int64), t, t, np.where(hit, t, _NEVER))
                if no_user in held:
                    new = tuple(map(np.concatenate, zip(held[no_user], new)))
                held[no_user] = _merged(*new, ttl_us)
                if len(held[no_user][0]) > HELD:
                    yield rows(held.pop(no_user), no_user)
        for no_user, left in held.items():
            yield rows(left, no_user)
    return work


def _user_state_fn(ttl_ms: int) -> Callable:
    def row(user_id, n, p, last, lastp, expired):
        return {"user_id": user_id, "as_of": last, "n_events": n, "n_purchases": p, "last_event": last,
                "last_purchase": lastp, "expired": expired}

    def fn(key, batches: Iterator[pd.DataFrame], state):
        (user_id,) = key
        if state.hasTimedOut:
            out = [row(user_id, *state.get, True)]
            state.remove()
            yield pd.DataFrame(out)
            return
        # the user's new spells in time order, merged batch by batch: never more than there are
        spells = None
        for b in batches:
            if len(b):
                new = (np.zeros(len(b), np.int64), *(b[c].to_numpy(np.int64) for c in ("n", "p", "first", "last", "last_p")))
                spells = _merged(*(new if spells is None else map(np.concatenate, zip(spells, new))), ttl_ms * 1000)
        if spells is None:
            return
        ttl = pd.Timedelta(milliseconds=ttl_ms)
        n, p, last, lastp = state.get if state.exists else (0, 0, None, None)
        out = []
        for own_n, own_p, *times in zip(*(x.tolist() for x in spells[1:])):
            begin, end, hit = (None if t == _NEVER else pd.Timestamp(t, unit="us") for t in times)
            if n and begin - last > ttl:
                out.append(row(user_id, n, p, last, lastp, True))
                n, p, last, lastp = 0, 0, None, None
            n, p = n + own_n, p + own_p
            last = end if last is None else max(last, end)
            if hit is not None:
                lastp = hit if lastp is None else max(lastp, hit)
        ends = pd.Timestamp(last).value // 1_000_000 + ttl_ms
        if ends < state.getCurrentWatermarkMs():  # already over: a timeout can't be set in the past
            out.append(row(user_id, n, p, last, lastp, True))
            if state.exists:
                state.remove()
        else:
            state.update((n, p, last, lastp))
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
            out.append(row(user_id, n, p, last, lastp, False))
        yield pd.DataFrame(out)
    return fn


def stream_user_state(stream: DataFrame, ttl: str, delay: str,
                      positive_type: str = "purchase") -> DataFrame:
    """P32. Per user: event and purchase counts, last event and last purchase
    time of the current spell. A spell ends when the next event is more than
    ``ttl`` of event time after the last one, or when the watermark passes
    that point (event-time timeout): its final row has ``expired = true`` and
    its state is released, and a user who returns starts at one. The answer
    is the same whether a gap falls inside a micro-batch or between two.
    Emits one row per user and ended spell, and one for the open spell, per
    micro-batch in which the user was seen or expired.

    Each task merges its events to spells before they move, so a user is a few
    rows per task and the state holds spells, however many events there are. A
    part of a spell is late if its last event is. Rows without a time are dropped."""
    ttl_ms = duration_us(ttl) // 1000
    events = stream.select("user_id", F.unix_micros(to_event_time("ts")).alias("t"),
                           F.coalesce(F.col("event_type") == positive_type, F.lit(False)).alias("hit"))
    spells = events.where(F.col("t").isNotNull()).mapInArrow(_spells_of(ttl_ms * 1000), SPELLS)
    s = spells.withColumn("event_time", F.timestamp_micros("last")).withWatermark("event_time", _interval(delay))
    return s.groupBy("user_id").applyInPandasWithState(
        _user_state_fn(ttl_ms), USER_STATE_OUT, USER_STATE, "append", "EventTimeTimeout")


#: a user's open spell; times in microseconds
OPEN_SPELL = "n bigint, p bigint, last bigint, last_p bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whose files go to
    the stream's checkpoint; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class UserSpells(StatefulProcessor):
    """One user's open spell as a value, its end as an event-time timer."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_SPELL)

    def _row(self, key, n, p, last, last_p, expired) -> list:
        at, hit = (None if t == _NEVER else pd.Timestamp(t, unit="us") for t in (last, last_p))
        return [key[0], at, n, p, at, hit, expired]

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=USER_STATE_OUT.fieldNames()).astype(
            {"as_of": "datetime64[us]", "last_event": "datetime64[us]", "last_purchase": "datetime64[us]"})

    def _end_ms(self, last: int) -> int:
        """The first millisecond that is past the spell's last instant."""
        return (last + self.ttl_us) // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spells = None
        for b in rows:
            if len(b):
                new = (np.zeros(len(b), np.int64), *(b[c].to_numpy(np.int64) for c in ("n", "p", "first", "last", "last_p")))
                spells = _merged(*(new if spells is None else map(np.concatenate, zip(spells, new))), self.ttl_us)
        if spells is None:
            return
        held = tuple(self.open.get()) if self.open.exists() else None
        if held:
            self.handle.deleteTimer(self._end_ms(held[2]))
        out = []
        for n, p, first, last, last_p in zip(*(x.tolist() for x in spells[1:])):
            if held and first - held[2] > self.ttl_us:
                out.append(self._row(key, *held, True))
                held = None
            held = (n, p, last, last_p) if held is None else (held[0] + n, held[1] + p, max(held[2], last), max(held[3], last_p))
        watermark = timerValues.getCurrentWatermarkInMs()
        over = self._end_ms(held[2]) < watermark
        out.append(self._row(key, *held, over))
        if over:
            self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer(self._end_ms(held[2]))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            held = tuple(self.open.get())
            self.open.clear()
            yield self._frame([self._row(key, *held, True)])

    def close(self) -> None:
        pass


def stream_user_timers(stream: DataFrame, ttl: str, delay: str, positive_type: str = "purchase") -> DataFrame:
    """P32 on ``transformWithState``: the rows of :func:`stream_user_state`,
    with the open spell as a value state and its end as an event-time timer.
    Start the stream under :func:`rocksdb_state`: state is on disk, so users
    are not bounded by memory, and can be read back between runs
    (:func:`open_spells`). A timer takes the place of a state TTL, which Spark
    has for processing time only. Late parts, rows without a time and events
    without a user are treated as there."""
    ttl_us = duration_us(ttl) // 1000 * 1000
    events = stream.select("user_id", F.unix_micros(to_event_time("ts")).alias("t"),
                           F.coalesce(F.col("event_type") == positive_type, F.lit(False)).alias("hit"))
    spells = events.where(F.col("t").isNotNull()).mapInArrow(_spells_of(ttl_us), SPELLS)
    s = spells.withColumn("event_time", F.timestamp_micros("last")).withWatermark("event_time", _interval(delay))
    return s.groupBy("user_id").transformWithStateInPandas(UserSpells(ttl_us), USER_STATE_OUT, "append", "eventTime")


def open_spells(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state a run of :func:`stream_user_timers` left at ``checkpoint``:
    one row per user with an open spell."""
    with rocksdb_state(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    when = {c: F.when(F.col(f"value.{c}") != _NEVER, F.timestamp_micros(f"value.{c}")).cast("timestamp_ntz") for c in ("last", "last_p")}
    return state.select("key.user_id", F.col("value.n").alias("n_events"), F.col("value.p").alias("n_purchases"),
                        when["last"].alias("last_event"), when["last_p"].alias("last_purchase"))


def latest_user_state(sink: DataFrame) -> DataFrame:
    """The last row written per user (expiry rows win over updates at the
    same time); times as TIMESTAMP_NTZ like the event log, plus whole days
    from the last purchase to the user's last event."""
    m = sink.groupBy("user_id").agg(F.max(F.struct("as_of", "expired", "n_events", "n_purchases",
                                                   "last_event", "last_purchase")).alias("m"))
    out = m.select("user_id", *[F.col(f"m.{c}").cast("timestamp_ntz").alias(c)
                                if c in ("as_of", "last_event", "last_purchase") else F.col(f"m.{c}")
                                for c in ("as_of", "expired", "n_events", "n_purchases",
                                          "last_event", "last_purchase")])
    days = F.floor(F.timestamp_diff("MICROSECOND", F.col("last_purchase"), F.col("last_event"))
                   / F.lit(86_400_000_000)).cast("bigint")
    return out.withColumn("days_since_purchase", days)


def run_available_now(spark: SparkSession, streaming_df: DataFrame, name: str,
                      output_mode: str = "append", sink: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Run ``streaming_df`` over all data available now into a parquet sink
    (exactly-once with the checkpoint), wait, return the sink as a batch
    DataFrame. Locations default to fresh folders under the shared
    checkpoint folder, so a rerun with the same paths resumes."""
    checkpoint_dir(spark)
    sink = sink or scratch_path(spark, f"{name}-sink")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-ckpt")
    q = (streaming_df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(streaming_df.schema).parquet(sink)
