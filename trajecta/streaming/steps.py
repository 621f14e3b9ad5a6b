"""Streaming forms of trajectory operators: windows of statistics, sessions, and stateful fixations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_statistics(events: DataFrame, key: str, time: str, value: str, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(key, start, end, n, mean, std) for each window; rows later than the watermark are left out."""
    w = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std")


def sessions(events: DataFrame, key: str, time: str, gap: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """(key, onset, offset, n): runs of events with less than gap between them, such as blinks to be joined."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("onset"), F.max(time).alias("offset")).select(key, "onset", "offset", "n")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """The result of an aggregation over what its sources hold now, each state of it written whole to path by the executors."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


OPEN = "n long, sx double, sy double, first double, last double, x double, y double, t double"


def fixation_stream(samples: DataFrame, key: str, threshold: float, min_duration: float = 0.0, late: str = "10 seconds") -> DataFrame:
    """(key, x, y, start_time, end_time, n) of fixations by velocity, emitted when they end.

    samples: key, ts (timestamp), t (seconds), x, y. State holds the last sample and the open fixation of each key; it is
    closed by a fast step or when the watermark passes it. Samples of a batch are put in order; later ones are left out.
    """
    kind = samples.schema[key].dataType.simpleString()
    names = [key, "x", "y", "start_time", "end_time", "n"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, sx, sy, first, last, x, y, t = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, None, None, None)
        out = []

        def close() -> None:
            nonlocal n, sx, sy
            if n and last - first >= min_duration:
                out.append((k[0], sx / n, sy / n, first, last, n))
            n, sx, sy = 0, 0.0, 0.0

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("t", kind="stable")
            for nx, ny, nt in rows[["x", "y", "t"]].itertuples(index=False):
                if t is not None and nt > t:
                    if ((nx - x) ** 2 + (ny - y) ** 2) ** 0.5 / (nt - t) <= threshold:
                        if not n:
                            first = t
                        n, sx, sy, last = n + 1, sx + x, sy + y, t
                    else:
                        close()
                if t is None or nt > t:
                    x, y, t = float(nx), float(ny), float(nt)
            state.update((n, sx, sy, first, last, x, y, t))
            edge = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(edge + 1, int(rows["ts"].max().timestamp() * 1000) + 1))
        yield pd.DataFrame(out, columns=names)

    out = f"`{key}` {kind}, x double, y double, start_time double, end_time double, n long"
    return samples.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, out, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
