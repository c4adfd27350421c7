"""Streams: keyed upserts by foreachBatch, a circuit breaker, and daily quotas that timers close at midnight."""

from __future__ import annotations

import contextlib
import datetime
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.sources.readers import drop_version, latest_version, merge_state, read_version, write_versioned  # noqa: F401 (latest_version reads what upsert_stream wrote)


def upsert_stream(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, kept: int = 2):
    """Each micro-batch is merged into the newest version of a state table; a replayed batch rewrites its own version.

    The last ``kept`` versions stay. A new checkpoint needs a new path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("v")).select(*keys, "v.*")
        merged = merge_state(read_version(spark, path, number - 1), newest, keys, order) if number else newest
        write_versioned(merged, path, number)
        if number >= kept:
            drop_version(spark, path, number - kept)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs an update-mode stream over what is there, and returns each key's last row: of the latest batch that had one."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number:08d}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path).drop("n")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def cooldown_stream(stream: DataFrame, least: int = 3, seconds: int = 300, delay: str = "300 seconds") -> DataFrame:
    """T5: per user_id, the streak of errors so far; open while it is at least ``least`` and the last error is under ``seconds`` old.

    stream: user_id long, event_type string, ts timestamp. Emits each user's state after a batch, and a closing row when the watermark (the
    largest ts of all users, less ``delay``) has passed the time limit without a row of the user. Rows behind the watermark are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, 0.0)
        parts = [] if state.hasTimedOut else list(batches)
        now = state.getCurrentWatermarkMs() / 1000
        if parts:
            rows = pd.concat(parts).sort_values("at", kind="stable")
            for kind, at in zip(rows["event_type"], rows["at"]):
                streak = streak + 1 if kind == "error" else 0
                last = at / 1e6 if kind == "error" else last
            now = max(now, rows["at"].max() / 1e6)
        is_open = bool(streak >= least and now - last < seconds)
        state.update((int(streak), float(last)))
        if is_open:
            state.setTimeoutTimestamp(max(math.ceil((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [int(streak)], "open": [is_open]})

    timed = stream.withWatermark("ts", delay).select("user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, streak long, open boolean", "streak long, last double", "update", "EventTimeTimeout")


@contextlib.contextmanager
def many_states(spark: SparkSession):
    """transformWithState keeps its states in RocksDB; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


DAY, DAY_MS = datetime.timedelta(days=1), 86_400_000
EPOCH = datetime.date(1970, 1, 1)


class DailyQuota(StatefulProcessor):
    """A user's counts of each day that is not over; a timer at the first one's midnight (UTC) emits and forgets all days that are over by then.

    The days are one value with one timer, as each call of the state's store is a message between two processes.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "day array<int>, used array<long>, errors array<long>")

    def close(self) -> None:
        pass

    def held(self) -> dict[int, tuple[int, int]]:
        found = self.days.get()
        return {d: (u, e) for d, u, e in zip(*found)} if found else {}

    def keep(self, days: dict[int, tuple[int, int]]) -> None:
        if days:
            order = sorted(days)
            self.days.update((order, [days[d][0] for d in order], [days[d][1] for d in order]))
        else:
            self.days.clear()

    def states(self, user: int, days: dict[int, tuple[int, int]], is_open: bool) -> pd.DataFrame:
        columns = ("user_id", "day", "used", "errors", "remaining", "open")
        return pd.DataFrame([(user, EPOCH + d * DAY, used, errors, max(0, self.limit - used), is_open) for d, (used, errors) in days.items()], columns=columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's names)
        held, changed = self.held(), {}
        first = min(held, default=None)
        for part in rows:
            for day, used, errors in zip(part["day"].tolist(), part["used"].tolist(), part["errors"].tolist()):
                before = held.get(day, (0, 0))
                held[day] = changed[day] = (before[0] + used, before[1] + errors)
        self.keep(held)
        if first is None or min(held) < first:
            self.handle.registerTimer((min(held) + 1) * DAY_MS)
        yield self.states(key[0], changed, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self.held()
        over = {d: n for d, n in held.items() if (d + 1) * DAY_MS <= now}
        left = {d: n for d, n in held.items() if d not in over}
        # A timer that an earlier day's came before finds its own day gone; that one's has set another for what is left.
        if over:
            self.keep(left)
            if left:
                self.handle.registerTimer((min(left) + 1) * DAY_MS)
            yield self.states(key[0], over, False)


def daily_quota(stream: DataFrame, limit: int, delay: str = "1 hour") -> DataFrame:
    """Per user_id and day (UTC), calls used, errors, what is left of the limit, and whether the day is still open.

    stream: user_id long, event_type string, ts timestamp. A call is any row that is no error; what is left never is below zero. Counters begin
    anew each day. Emits a day's state after each batch that had rows of it, and once more, closed, when the watermark has passed its end; rows
    of closed days are left out. Rows without a user or time are left out. Rows are counted by user and day within each task before they
    are shuffled, so a user with very many rows is few. Needs many_states().
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                rows["day"] = rows["at"] // 86_400_000_000
                groups = rows.groupby(["user_id", "day"], as_index=False).agg(ts=("ts", "max"), used=("call", "sum"), errors=("error", "sum"))
                yield groups

    error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    timed = stream.filter("user_id is not null and ts is not null").select("user_id", "ts", F.unix_micros("ts").alias("at"), error.cast("long").alias("error"), (~error).cast("long").alias("call"))
    parts = timed.mapInPandas(counted, "user_id long, day long, ts timestamp, used long, errors long").withWatermark("ts", delay)
    return parts.groupBy("user_id").transformWithStateInPandas(DailyQuota(limit), "user_id long, day date, used long, errors long, remaining long, open boolean", "Update", "EventTime")
