"""Structured Streaming forms of the windowed operators; each works on batch tables too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cadenza.operators.recurrences import linear_state, scanned


def late(df: DataFrame, allowed: str) -> DataFrame:
    """The watermark on a stream; batch tables stay as they are."""
    return df.withWatermark("ts", allowed) if df.isStreaming else df


def tumbling(df: DataFrame, width: str, allowed: str = "1 hour") -> DataFrame:
    """Root mean square, mean and maximum of each series in windows one after the other."""
    windows = late(df, allowed).groupBy(F.window("ts", width).alias("w"), "series_id")
    return windows.agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.avg("v").alias("mean"), F.max("v").alias("high")).select(F.col("w.start").alias("start"), "series_id", "rms", "mean", "high")


def sliding(df: DataFrame, width: str, hop: str, allowed: str = "1 hour") -> DataFrame:
    """Mean and count in overlapping windows."""
    windows = late(df, allowed).groupBy(F.window("ts", width, hop).alias("w"), "series_id")
    return windows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "series_id", "mean", "n")


def sessions(df: DataFrame, gap: str, allowed: str = "1 hour") -> DataFrame:
    """Runs of frames with less than `gap` between them."""
    windows = late(df, allowed).groupBy(F.session_window("ts", gap).alias("w"), "series_id")
    return windows.agg(F.count("*").alias("n"), F.sum("v").alias("total")).select(F.col("w.start").alias("start"), "series_id", "n", "total")


def enriched(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """A stream beside stored statistics (one row a key): z-scores."""
    return df.join(stats, key).withColumn("z", F.try_divide(F.col("v") - F.col("mean"), F.col("std"))).drop("mean", "std")


def running_moments(df: DataFrame) -> DataFrame:
    """Sums from which correlations follow, kept up to date (update mode): series_id, n, sx, sy, sxx, sxy, syy."""
    x, y = F.col("x"), F.col("y")
    return df.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


#: Layout of the state below; a query restarted from a checkpoint of another one stops with an error.
STATE_VERSION = 2


class InOrder(StatefulProcessor):
    """Holds the frames of a series by event time, and lets them go in that order once the watermark has passed them.

    A frame at or before the watermark when it arrives is late and dropped: later frames may have gone. A timer stands at the earliest frame held; when it
    fires, all frames up to the watermark go, and the next timer is set. What is carried from frame to frame (`state`, numbers) is kept beside the time of
    the last one. After `forget` microseconds without a frame a series starts anew, in the results as in what is kept: its state is deleted when the watermark has passed that time.
    """

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def step(self, state: list[float] | None, values: np.ndarray) -> tuple[list[float], list]:
        """The state after these values of a series, and a result (or None) for each."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", StructType([StructField("us", LongType())]), StructType([StructField("v", ArrayType(DoubleType()))]))
        self.last = handle.getValueState("last", StructType([StructField("version", IntegerType()), StructField("us", LongType()), StructField("state", ArrayType(DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = pd.concat([r[["us", "v"]] for r in rows])
        frames = frames[frames["us"] > passed] if passed > 0 else frames
        for us, own in frames.groupby("us")["v"]:
            before = list(self.held.getValue((int(us),))[0]) if self.held.containsKey((int(us),)) else []
            self.held.updateValue((int(us),), (before + own.astype(float).tolist(),))
        if len(frames):
            self._wake(int(frames["us"].min()))
        yield self._rows(key, [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = {k[0]: list(v[0]) for k, v in self.held.iterator()}
        due = sorted(us for us in held if us <= passed)
        times = [us for us in due for _ in held[us]]
        values = np.array([v for us in due for v in sorted(held[us])], float)
        for us in due:
            self.held.removeKey((us,))
        version, before, state = self.last.get() if self.last.exists() else (STATE_VERSION, None, None)
        if version != STATE_VERSION:
            raise ValueError(f"the checkpoint holds state of version {version}, this is {STATE_VERSION}")
        out = []
        for a, b in self._runs(before, times):
            fresh = a > 0 or before is not None and self.forget is not None and bool(times) and times[0] - before > self.forget
            state, found = self.step(None if fresh or state is None else list(state), values[a:b])
            out += found
        if times:
            before = times[-1]
            self.last.update((STATE_VERSION, before, [float(x) for x in state]))
        waiting = [us for us in held if us > passed]
        if waiting:
            self._wake(min(waiting))
        elif self.forget is not None and before is not None:
            if before + self.forget < passed:
                self.last.clear()
            else:
                self._wake(before + self.forget)
        yield self._rows(key, times, out)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _runs(self, before: int | None, times: list[int]) -> list[tuple[int, int]]:
        """Stretches of the frames without a gap of more than `forget`."""
        if not times:
            return []
        cuts = [i for i in range(1, len(times)) if self.forget is not None and times[i] - times[i - 1] > self.forget]
        return list(zip([0, *cuts], [*cuts, len(times)]))

    def _rows(self, key, times: list[int], out: list) -> pd.DataFrame:
        rows = [(key[0], us, x) for us, x in zip(times, out) if x is not None]
        return pd.DataFrame(rows, columns=["series_id", "us", "out"])

    def close(self) -> None:
        pass


class LastFrame(InOrder):
    """Absolute difference to the frame before."""

    def step(self, state, values):
        before = np.concatenate([state or [np.nan], values[:-1]])
        steps = np.abs(values - before)
        return [values[-1]], [None if np.isnan(x) else float(x) for x in steps]


class Projection(InOrder):
    """The state of a linear recurrence after each frame."""

    def __init__(self, transition: np.ndarray, source: np.ndarray, forget: int | None = None):
        super().__init__(forget)
        self.transition, self.source = transition, source

    def step(self, state, values):
        inputs = np.outer(values, self.source)
        if state is not None:
            inputs[0] += self.transition @ np.asarray(state)
        states = scanned(inputs, self.transition)
        return states[-1].tolist(), [row.tolist() for row in states]


def _in_order(df: DataFrame, allowed: str, job: InOrder, kind: str, name: str) -> DataFrame:
    """The job's results (series_id, ts, `name`) of a stream."""
    series = df.schema["series_id"].dataType.simpleString()
    rows = late(df, allowed).select("series_id", "ts", F.col("v").cast("double").alias("v"), F.unix_micros("ts").alias("us")).where("us IS NOT NULL AND v IS NOT NULL")
    out = rows.groupBy("series_id").transformWithStateInPandas(job, f"series_id {series}, us long, out {kind}", "Append", "EventTime")
    return out.select("series_id", F.timestamp_micros("us").alias("ts"), F.col("out").alias(name))


def _micros(span: str | None) -> int | None:
    """A span such as "2 hours" in microseconds."""
    return None if span is None else int(pd.Timedelta(span) // pd.Timedelta("1us"))


def _fresh(order, forget: int | None) -> Column:
    """Whether a frame begins a stretch: the first, or more than `forget` after the one before."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    return gap.isNull() | (gap > forget if forget is not None else F.lit(False))


def differences(df: DataFrame, allowed: str = "1 hour", forget: str | None = None) -> DataFrame:
    """Absolute differences to the frame before (series_id, ts, step) of series (series_id, ts, v), in the order of event time; frames of one time go by value. After a
    gap of more than `forget` a series starts anew. Frames without a time or value are left out. Of a stream, frames go on when the watermark has passed them, and those that arrive later are dropped."""
    if df.isStreaming:
        return _in_order(df, allowed, LastFrame(_micros(forget)), "double", "step")
    order = Window.partitionBy("series_id").orderBy("ts", "v")
    rows = df.where("ts IS NOT NULL AND v IS NOT NULL").select("series_id", "ts", F.col("v").cast("double").alias("v"))
    step = F.when(~_fresh(order, _micros(forget)), F.abs(F.col("v") - F.lag("v").over(order)))
    return rows.select("series_id", "ts", step.alias("step")).where("step IS NOT NULL")


def projected(df: DataFrame, transition: np.ndarray, source: np.ndarray, allowed: str = "1 hour", forget: str | None = None) -> DataFrame:
    """series_id, ts, state: the online projection of each series (series_id, ts, v), ordered and begun anew as in differences(); batch tables go through the chunked recurrence."""
    if df.isStreaming:
        return _in_order(df, allowed, Projection(transition, source, _micros(forget)), "array<double>", "state")
    order = Window.partitionBy("series_id").orderBy("ts", "v")
    rows = df.where("ts IS NOT NULL AND v IS NOT NULL").select("series_id", "ts", F.col("v").cast("double").alias("v"))
    rows = rows.withColumn("run", F.sum(_fresh(order, _micros(forget)).cast("int")).over(order))
    placed = rows.withColumn("t", (F.row_number().over(Window.partitionBy("series_id", "run").orderBy("ts", "v")) - 1).cast("int"))
    placed = placed.select(F.struct("series_id", "run").alias("series_id"), "t", "ts", "v")
    states = linear_state(placed, transition, source).join(placed.select("series_id", "t", "ts"), ["series_id", "t"])
    return states.select("series_id.series_id", "ts", "state")
