"""Captioning of newly arrived series, each file once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.windows import sliding_windows
from ..sources.writers import append_records

POINTS = "series_key string, t long, ts timestamp, value double"


WINDOWS = "series_key string, t long, ts timestamp, value double, w_start long, w_end long, n long, i long"
STATE = "next_window long, seen long, t array<long>, ts array<timestamp>, value array<double>"
#: Windows that leave the state at once.
AT_ONCE = 1000


def growing_windows(points: DataFrame, length: int, stride: int) -> DataFrame:
    """The windows of series that arrive piece by piece, each as soon as its last point is there.

    points: a stream of series_key, t, ts, value. The state of a series is the number of its next window and the points
    from that window's start on, less than `length` + `stride` of them; it holds for ever. Points may lie in any order
    within an arrival; those at or before the last place of an earlier one are late and left out. A series shorter than
    `length` has no window until it has grown to it, where the batch job makes one of the whole series.
    """

    def grow(key, frames, state):
        next_window, seen, *held = state.get if state.exists else (0, -1, [], [], [])
        tail = pd.DataFrame({"t": pd.Series(held[0], dtype="int64"), "ts": pd.to_datetime(pd.Series(held[1], dtype="datetime64[ns]")), "value": pd.Series(held[2], dtype="float64")})
        new = [f[["t", "ts", "value"]] for f in frames]
        new = [f[f["t"] > seen] for f in new]
        own = pd.concat([tail, *[f for f in new if len(f)]]).drop_duplicates("t", keep="first").sort_values("t", ignore_index=True) if any(len(f) for f in new) else tail
        place = own["t"].to_numpy(np.int64)
        if len(place):
            seen = max(seen, int(place[-1]))
        ready = (seen + 1 - length) // stride + 1 if seen + 1 >= length else 0  # windows whole by now
        for begin in range(next_window, ready, AT_ONCE):
            starts = np.arange(begin, min(begin + AT_ONCE, ready)) * stride
            low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + length)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            out = own.iloc[rows].reset_index(drop=True)
            w_start = np.repeat(starts, high - low)
            out.insert(0, "series_key", key[0])
            yield out.assign(w_start=w_start, w_end=w_start + length - 1, n=length, i=out["t"].to_numpy() - w_start)
        next_window = max(next_window, ready)
        own = own[own["t"] >= next_window * stride]
        state.update((next_window, seen, own["t"].tolist(), [x.to_pydatetime() if not pd.isna(x) else None for x in own["ts"]], [None if pd.isna(x) else float(x) for x in own["value"]]))

    return points.groupBy("series_key").applyInPandasWithState(grow, WINDOWS, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_records(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], length: int = 512, stride: int = 256, files_per_batch: int = 1000, growing: bool = False) -> None:
    """Takes the Parquet files of points that are new in `in_dir`, builds records of their windows and appends them.

    A series arrives whole within a batch; with `growing`, in pieces over many (see growing_windows()). The checkpoint remembers files; should a batch be delivered again after a
    failure, it replaces what it has written. A batch costs the same however much is out: earlier ones of the same
    checkpoint are not read, those of another one only where their keys meet.
    """
    own = spark.newSession()  # the state store is this stream's own choice
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arrived = own.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).parquet(in_dir)

    def sink(batch: DataFrame, number: int) -> None:
        identity = spark.read.text(f"{checkpoint}/metadata").where("value like '%id%'").first().value  # written at the start
        stream = re.search(r'"id"\s*:\s*"([^"]+)"', identity)[1]
        append_records(build(batch if growing else sliding_windows(batch, length, stride)), out_dir, stream, number)

    (growing_windows(arrived, length, stride) if growing else arrived).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
