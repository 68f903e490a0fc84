"""State kept between micro-batches.

The two processors hold a key's rows of one micro-batch to bring them in order; the scan's
``files_per_batch`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampType

from vigilark.functions.temporal import event_time, micros_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Let events be up to ``delay`` late; state older than that is dropped."""
    return event_time(df, time).withWatermark(time, delay)


def deduplicate_events(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark's delay of the first.

    State holds one entry per key seen within the delay, and no longer.
    """
    return df.dropDuplicatesWithinWatermark(list(keys))


def windowed_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two streams of windowed results on window and keys.

    Each side has one row per window and key, so no group multiplies.
    """
    on = ["window_start", "window_end", *keys]
    return left.join(right, on)


class DriftProcessor(StatefulProcessor):
    """Upward cumulative sum per key; a key that stays silent for ``idle_ms`` starts anew.

    Rows of a key are taken in (time, order) within a micro-batch. The sum is one number per
    key, held in the state store and written with the query's checkpoint.
    """

    def __init__(self, key: str, time: str, order: str, value: str, target: str, slack: float, bound: float, idle_ms: int):
        self.columns = (key, time, order, value, target)
        self.slack, self.bound, self.idle_ms = slack, bound, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sum = handle.getValueState("sum", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, time, order, value, target = self.columns
        held = self.sum.get()
        total = held[0] if held is not None else 0.0
        batch = pd.concat(list(rows)).sort_values([time, order])
        steps = (batch[value] - batch[target] - self.slack).to_numpy(float)
        steps = np.where(np.isnan(steps), 0.0, steps)  # a row without a value changes nothing
        run = total + np.cumsum(steps)
        # A sum held at zero from below is the running sum less its running minimum below zero.
        sums = run - np.minimum(np.minimum.accumulate(run), 0.0)
        after, before = np.round(sums, 6), np.round(np.concatenate([[total], sums[:-1]]), 6)
        alarms = np.flatnonzero((after > self.bound) & (before <= self.bound))
        if len(alarms):
            yield batch.iloc[alarms].assign(drift=after[alarms])
        self.sum.update((float(sums[-1]),))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch[time].max().timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sum.clear()
        return iter([])

    def close(self) -> None:
        pass


def drift_state(
    df: DataFrame,
    key: str,
    time: str,
    order: str,
    value: str,
    target: str,
    slack: float,
    bound: float,
    idle_ms: int = 0,
) -> DataFrame:
    """Streaming form of ``drift_alarms``; the input carries a watermark on ``time``.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
    """
    output = StructType([*df.schema.fields, StructField("drift", DoubleType())])
    return df.groupBy(key).transformWithStateInPandas(
        DriftProcessor(key, time, order, value, target, slack, bound, idle_ms),
        outputStructType=output,
        outputMode="append",
        timeMode="eventTime",
    )


class FollowProcessor(StatefulProcessor):
    """Waiting rows per key, each given out with the first follower within ``within_ms``.

    The first follower settles all waiting rows at once, so work is linear in the rows. Rows
    of a key are taken in (time, order) within a micro-batch. The waiting rows are read only when
    a follower comes or the timer of the oldest expires; else new ones are appended. Rows that the watermark has left
    behind by more than ``within_ms`` are dropped by that timer, so the state holds no more than that span.
    """

    def __init__(self, key: str, time: str, order: str, follows: str, names: tuple[str, str], within_ms: int):
        self.columns = (key, time, order, follows)
        self.names, self.within_ms = names, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "number bigint, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, time, order, follows = self.columns
        within = pd.Timedelta(milliseconds=self.within_ms)
        batch = pd.concat(list(rows)).sort_values([time, follows, order])
        anyone = bool(batch[follows].any())
        waiting = [(number, pd.Timestamp(at)) for number, at in self.waiting.get()] if anyone else []
        found = []
        for at, number, is_follower in zip(batch[time], batch[order], batch[follows]):
            if not is_follower:
                waiting.append((number, at))
                continue
            found += [(key[0], w, t, number, at) for w, t in waiting if at - t <= within]
            waiting = []
        state = [(int(number), at.to_pydatetime()) for number, at in waiting]
        if anyone:
            self._hold(state)
        elif state:
            self.waiting.appendList(state)
            due = self._due(state)
            timers = list(self.handle.listTimers())
            if not timers or due < min(timers):
                self._set_timer(due)
        if found:
            yield pd.DataFrame(found, columns=[name, order, time, *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = timerValues.getCurrentWatermarkInMs() - self.within_ms
        self._hold([(n, at) for n, at in self.waiting.get() if pd.Timestamp(at).timestamp() * 1000 >= left])
        return iter([])

    def _due(self, rows: list) -> int:
        """Just after the last moment at which the oldest row can be followed."""
        return int(min(pd.Timestamp(at).timestamp() for _, at in rows) * 1000) + self.within_ms + 1

    def _set_timer(self, due: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def _hold(self, rows: list) -> None:
        if rows:
            self.waiting.put(rows)
            self._set_timer(self._due(rows))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def followed_state(
    df: DataFrame, key: str, time: str, order: str, follows: str, names: tuple[str, str], within_ms: int
) -> DataFrame:
    """Streaming form of a forward ``as_of`` with ``within``: the first follower of each other row.

    ``follows`` is a boolean column that marks followers; ``names`` are the output columns for
    the follower's order and time. The input carries a watermark on ``time``. Needs ``ROCKSDB``.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    output = StructType(
        [
            *[StructField(n, kinds[n]) for n in (key, order, time)],
            StructField(names[0], kinds[order]),
            StructField(names[1], kinds[time]),
        ]
    )
    return df.select(key, time, order, follows).groupBy(key).transformWithStateInPandas(
        FollowProcessor(key, time, order, follows, names, within_ms),
        outputStructType=output,
        outputMode="append",
        timeMode="eventTime",
    )


class LateProcessor(StatefulProcessor):
    """Rows more than ``delay`` behind the latest time that arrived before them; one time per key is held."""

    def __init__(self, arrival: Sequence[str], time: str, delay: pd.Timedelta):
        self.arrival, self.time, self.delay = list(arrival), time, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "nanos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get()
        batch = pd.concat(list(rows)).sort_values(self.arrival, kind="stable")
        times = batch[self.time]
        first = pd.Series([pd.NaT if held is None else pd.Timestamp(held[0], tz=times.dt.tz)], dtype=times.dtype)
        upto = pd.concat([first, times]).cummax().ffill()
        seen = upto.iloc[:-1].set_axis(batch.index)
        late = (times < seen - self.delay).to_numpy()
        if late.any():
            yield batch[late].assign(seen_until=seen[late])
        if pd.notna(upto.iloc[-1]):
            self.latest.update((upto.iloc[-1].value,))

    def close(self) -> None:
        pass


def late_state(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], time: str, delay: str) -> DataFrame:
    """Streaming form of ``late_events``: late rows with ``seen_until``, as rows of their own where Spark would drop them silently.

    Lateness is judged per key, such as a device or a source, against the latest time that arrived before; within a
    micro-batch rows arrive in the order of ``arrival``. The input has no watermark, which would drop the very rows that are
    asked for, and its times are timestamps with zone. Rows without a time are never late. Needs ``ROCKSDB`` as the store.
    """
    output = StructType([*df.schema.fields, StructField("seen_until", TimestampType())])
    return df.groupBy(*keys).transformWithStateInPandas(
        LateProcessor(arrival, time, pd.Timedelta(microseconds=micros_of(delay))), outputStructType=output, outputMode="append", timeMode="none"
    )


class RollingProcessor(StatefulProcessor):
    """Each closed window against the ``rows`` before it of its group, which are held as a list."""

    def __init__(self, time: str, value: str, rows: int, least_z: float):
        self.time, self.value, self.rows, self.least_z = time, value, rows, least_z

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.ring.get()]
        batch = pd.concat(list(rows)).sort_values(self.time)
        run = pd.Series(held + batch[self.value].astype(float).tolist())
        before = run.shift(1).rolling(self.rows, min_periods=1)
        spread = before.std()
        z = ((run - before.mean()) / spread.where(spread > 0))[len(held) :].to_numpy()
        high = np.flatnonzero(np.round(z, 9) >= self.least_z)
        if len(high):
            yield batch.iloc[high].assign(z=z[high])
        self.ring.put([(float(v),) for v in run.iloc[-self.rows :]])

    def close(self) -> None:
        pass


def rolling_state(counts: DataFrame, groups: Sequence[str], time: str, value: str, rows: int, least_z: float) -> DataFrame:
    """Streaming form of ``rolling_anomalies`` over a stream of windowed counts in append mode.

    The counts come when the watermark closes their windows, so a group's windows arrive in order, late events counted;
    the ring of the last ``rows`` values is all that is held per group. Needs ``ROCKSDB`` as the store.
    """
    output = StructType([*counts.schema.fields, StructField("z", DoubleType())])
    return counts.groupBy(*groups).transformWithStateInPandas(
        RollingProcessor(time, value, rows, least_z), outputStructType=output, outputMode="append", timeMode="none"
    )
