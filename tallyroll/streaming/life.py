"""Keyed state with timers. Results that expire, and failed submissions that wait for their next try.

All times are event times: a timer fires in the first batch whose watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.jobs import public_result, public_status
from ..operators.predict import Runner, built, predict

RESULT_LIFE = 86_400  # seconds
RETRY_DELAY = 2  # seconds between tries
ATTEMPTS = 4  # the first and three more
BUCKETS = 4096  # of jobs that share a timer; a bucket has a fixed cost in each batch
_HELD_ROWS, _HELD_BYTES = 4096, 1 << 24  # of waiting jobs, written to the state at once
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _timers_allowed(spark: SparkSession) -> Iterator[None]:
    """Timers need a state store with several column families; a query keeps what is set when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _LastState(StatefulProcessor):
    """The last state of a job; forgotten when the watermark, a result's life behind the newest event, reaches it."""

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: (r.at, r.event_id))
        old = tuple(self._last.get()) if self._last.exists() else None
        if old is not None and (new.at, new.event_id) <= old:
            return
        if old is not None:
            self._handle.deleteTimer(old[0] // 1000)
        self._last.update((new.at, new.event_id))
        self._handle.registerTimer(new.at // 1000)
        yield Row(job_id=key[0], at=new.at, state=new.state, result=new.result)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._last.clear()
        yield from ()

    def close(self) -> None:
        pass


def start_expiring_states(events: DataFrame, out: str, checkpoint: str, life: int = RESULT_LIFE):
    """R2 with result life: changed jobs of every batch with the time they expire.

    Events may come in any order. One that is older than ``life`` when it comes is
    dropped: whatever it says has expired, and a newer state of its job is not
    touched by it. State is kept for jobs of the last ``life`` seconds only, and so
    are the folders of changes.
    """
    job_type = events.schema["job_id"].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(
            "job_id", public_status(F.col("state")).alias("status"), public_result(F.col("state"), F.col("result")).alias("result"),
            F.timestamp_micros(F.col("at") + life * 1_000_000).alias("expires_at"))
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        _drop_expired(batch.sparkSession, out, life)

    rows = events.withWatermark("ts", f"{life} seconds").withColumn("at", F.unix_micros("ts"))
    with _timers_allowed(events.sparkSession):
        changes = rows.groupBy("job_id").transformWithState(
            _LastState(), f"job_id {job_type}, at bigint, state string, result string", "update", "eventTime")
        return (
            changes.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _drop_expired(spark: SparkSession, out: str, life: int) -> None:
    """Delete the folders in which every change has expired; one row per folder comes to the driver."""
    log = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    until = {r.batch: r.until for r in log.groupBy("batch").agg(F.max(F.unix_micros("expires_at")).alias("until")).collect()}
    if not until:
        return
    now = max(until.values()) - life * 1_000_000
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for batch, last in until.items():
        if last <= now:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={batch}"), True)


def live_states(spark: SparkSession, out: str, life: int = RESULT_LIFE) -> DataFrame:
    """``job_id, status, result, expires_at`` of the jobs whose last state is younger than ``life`` at the newest event."""
    log = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    now = log.agg((F.max(F.unix_micros("expires_at")) - life * 1_000_000).alias("now"))
    newest = log.groupBy("job_id").agg(F.max(F.struct("expires_at", "batch")).alias("_l")).select(
        F.col("job_id").alias("_job"), "_l.*")
    same = F.col("job_id").eqNullSafe(F.col("_job")) & (log.expires_at == newest.expires_at) & (log.batch == newest.batch)
    last = log.join(newest, same).select("job_id", "status", "result", log.expires_at)
    return last.join(F.broadcast(now), F.unix_micros("expires_at") > F.col("now")).drop("now")


class _Waiting(StatefulProcessor):
    """Holds the images of failed submissions until their next tries are due; answers pass through.

    Jobs are dealt over buckets, and a bucket has one timer and one list of those that wait: a call
    of the state serves many jobs. Lists are read and written in pieces, never held whole.
    """

    def __init__(self, model_id: str, factory: Callable[[], Runner], attempts: int, delay: int, job_type: str) -> None:
        self._model_id, self._factory, self._attempts, self._delay = model_id, factory, attempts, delay * 1_000_000
        self._waiting = f"job_id {job_type}, content binary, number int, due bigint"

    def init(self, handle) -> None:
        self._handle = handle
        self._lists = [handle.getListState(name, self._waiting) for name in ("even", "odd")]  # one of them is empty
        self._next = handle.getValueState("next", "at bigint, list int")

    def _settled(self, held: list, job, number: int, due: int, raw: str | None, error: str | None, image: bytes | None) -> Row:
        again = error is not None and number < self._attempts
        if again:
            held.append((job, image, number + 1, due + self._delay))
        return Row(job_id=job, attempt=number, due=due, raw=raw, error=error, waits=again)

    def _flushed(self, held: list, to, first: int | None) -> int | None:
        """Moves ``held`` to the list; the earliest time, in ms, of what is there."""
        if not held:
            return first
        first = min(d // 1000 for *_, d in held) if first is None else min(first, *(d // 1000 for *_, d in held))
        to.appendList(held)
        held.clear()
        return first

    @staticmethod
    def _full(held: list) -> bool:
        return len(held) >= _HELD_ROWS or (len(held) % 64 == 0 and sum(len(i or b"") for _, i, _, _ in held) >= _HELD_BYTES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, at = self._next.get() if self._next.exists() else (None, 0)
        jobs = {job for job, *_ in self._lists[at].get()} if before is not None else set()
        held, first = [], before
        for row in rows:
            if row.job_id not in jobs:  # a submission repeated while it waits changes nothing
                done = self._settled(held, row.job_id, 1, row.at, row.raw, row.error, row.image)
                if done.waits:
                    jobs.add(row.job_id)
                    if self._full(held):
                        first = self._flushed(held, self._lists[at], first)
                yield done
        first = self._flushed(held, self._lists[at], first)
        if first != before:
            if before is not None:
                self._handle.deleteTimer(before)
            self._next.update((first, at))
            self._handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if not self._next.exists():
            return
        before, at = self._next.get()
        if before != fired:
            return
        held, first = [], None
        for job, image, number, due in self._lists[at].get():
            if due // 1000 > fired and due // 1000 >= now:
                held.append((job, image, number, due))
            else:
                raw, error = None, None
                try:
                    raw = built(self._model_id, self._factory).attempt(bytes(image), number)
                except Exception as exc:
                    error = f"{type(exc).__name__}: {exc}"
                yield self._settled(held, job, number, due, raw, error, image)
            if self._full(held):
                first = self._flushed(held, self._lists[1 - at], first)
        first = self._flushed(held, self._lists[1 - at], first)
        self._lists[at].clear()
        if first is None:
            self._next.clear()
        else:
            first = max(first, fired + 1)  # the timer that fired is deleted after this call
            self._next.update((first, 1 - at))
            self._handle.registerTimer(first)

    def close(self) -> None:
        pass


def start_retrying(
    submitted: DataFrame, model_id: str, factory: Callable[[], Runner], out: str, checkpoint: str,
    attempts: int = ATTEMPTS, delay: int = RETRY_DELAY, buckets: int = BUCKETS,
):
    """R4 with a wait: ``job_id, content, ts`` through a model; each try is a row of ``out``.

    First tries run in Arrow batches. A failed one leaves the task: its image waits
    in the state of its job's bucket, and a timer brings it back ``delay`` seconds after the
    try before, in the batch whose watermark passes that time, ``attempts`` times in
    all. No task sleeps. Rows that come behind the watermark are too late for timers
    and dropped, so submissions should come about in time order.
    """
    job_type = submitted.schema["job_id"].dataType.simpleString()
    timed = submitted.withWatermark("ts", "0 seconds").select(
        "job_id", "ts", F.unix_micros("ts").alias("at"), F.col("content").alias("image"), "content")
    tried = predict(timed, model_id, factory, attempts=1).withColumn(
        "image", F.when(F.col("error").isNotNull(), F.col("image"))).select(
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket"), "job_id", "ts", "at", "image", "raw", "error")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("due", F.timestamp_micros("due")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _timers_allowed(submitted.sparkSession):
        answers = tried.groupBy("bucket").transformWithState(
            _Waiting(model_id, factory, attempts, delay, job_type),
            f"job_id {job_type}, attempt int, due bigint, raw string, error string, waits boolean", "update", "eventTime")
        return (
            answers.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def tries(spark: SparkSession, out: str) -> DataFrame:
    """Every try so far: ``job_id, attempt, due, raw, error, waits`` and its batch."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")
