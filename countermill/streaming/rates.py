"""Counter rates over a stream, with state per time slice and bucket of series.

A point belongs to the slice it falls into and, if a later window can reach back to it, to the slices
after it. The home slice answers; the others only remember the point. So one busy series spreads over
as many tasks as its micro-batch has slices, and state is bounded: a slice keeps the points that its
windows can still reach, and a timer removes it when the watermark has passed its end.

Series share buckets, by the hash of their keys, and all series of a bucket and slice are rated in one
call: a fleet of many quiet series costs calls per bucket, not per series. Points stay apart by series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from countermill.operators.slices import slice_start
from countermill.vocab import RATE_WINDOW_SECONDS, SECOND_US, UINT32_MAX

#: Points by series, then time and arrival; `sizes` has how many each series has, `points` their us, seq and raw.
STATE = "series array<string>, sizes array<int>, points binary"
#: Part of a checkpoint, as its keys are bucket numbers: another number needs a new checkpoint.
BUCKETS = 1024


def rates_of(
    own: np.ndarray, at: np.ndarray, value: np.ndarray, series: np.ndarray, us: np.ndarray, raw: np.ndarray,
    window_us: int, inclusive: bool, turn: int | None,
) -> np.ndarray:
    """Rates of rows (own series, at, value), each against the first point of its series in its window;
    points (series, us, raw) are in order of series, time and arrival and hold the rows themselves."""
    times, rank = np.unique(np.concatenate([us, at - window_us]), return_inverse=True)
    place, start = series * len(times) + rank[: len(us)], own * len(times) + rank[len(us) :]
    first = np.searchsorted(place, start, side="left" if inclusive else "right")
    change = value - raw[first]
    if turn is not None:
        change = np.where(change < 0, change + turn, change)
    elapsed = at - us[first]
    rates = np.full(len(at), np.nan)
    moved = elapsed > 0
    rates[moved] = change[moved] / (elapsed[moved] / float(SECOND_US))
    return rates


def in_slices(rows: DataFrame, window_us: int, slice_us: int, gate: str | None) -> DataFrame:
    """Rows once in their home slice (`_asks`) and, as points, once in every later slice whose windows reach
    them. Only the asking copy carries the other columns. A row without a time asks and is no point."""
    step = F.lit(slice_us).cast("bigint")
    home = slice_start(F.col("us"), slice_us)
    counted = F.lit(True) if gate is None else F.col(gate).isNotNull()
    point = F.col("us").isNotNull() & counted
    reached = F.sequence(home, slice_start(F.col("us") + F.lit(window_us), slice_us), step)
    return rows.withColumn("_point", point).withColumn("_slice", F.explode(F.when(point, reached).otherwise(F.array(home))))


def stream_rate(
    rows: DataFrame,
    window_seconds: int = RATE_WINDOW_SECONDS,
    inclusive: bool = True,
    wrap: str | None = "compat",
    value: str = "raw_value",
    gate: str | None = "processed_value",
    keys: tuple[str, ...] = ("device_id", "channel"),
    lateness_seconds: int = RATE_WINDOW_SECONDS,
    slice_seconds: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add `rate` to a stream that carries `us` and `seq`.

    A micro-batch is put into time order per series, so on input whose batches follow each other in time
    the result equals the batch operator. A row may come up to `lateness_seconds` behind the newest row of
    earlier batches, of any series, and is rated against the points that have come by then; older rows are
    left out here, and `late_rows` keeps them. A slice is four windows wide unless `slice_seconds` says
    otherwise; narrower ones spread a busy series further and copy each point more often. One call holds the
    points and rows of one of `buckets` in one slice.

    Rows whose `gate` column is null are no points and have no rate; so have rows without a time. Null keys
    are a series of their own.
    """
    window_us = window_seconds * SECOND_US
    slice_us = slice_seconds * SECOND_US if slice_seconds else 4 * window_us
    keep_us = window_us + lateness_seconds * SECOND_US
    turn = None if wrap is None else {"compat": UINT32_MAX, "exact": UINT32_MAX + 1}[wrap]
    schema = T.StructType([*rows.schema.fields, T.StructField("rate", T.DoubleType())])
    columns = schema.fieldNames()

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = list(frames)
        names, sizes, packed = state.get if state.exists else ([], [], b"")
        points = [frame.loc[frame["_point"], ["_series", "us", "seq", value]] for frame in batch]
        series, known = pd.factorize(np.concatenate([np.repeat(np.array(names, object), sizes), *(p["_series"] for p in points)]))
        us, seq, raw = (
            np.concatenate([old, *(p[name].to_numpy(dtype="int64") for p in points)])
            for old, name in zip(np.frombuffer(packed, "int64").reshape(3, -1), ("us", "seq", value), strict=True)
        )
        order = np.lexsort((seq, us, series))
        series, us, seq, raw = series[order], us[order], seq[order], raw[order]
        for frame in batch:
            frame = frame[frame["_asks"]]
            if not len(frame):
                continue
            counted = frame["_point"].to_numpy(dtype=bool)
            rates = np.full(len(frame), np.nan)
            own = pd.Index(known).get_indexer(frame.loc[counted, "_series"])
            at, now = (frame.loc[counted, name].to_numpy(dtype="int64") for name in ("us", value))
            rates[counted] = rates_of(own, at, now, series, us, raw, window_us, inclusive, turn)
            found = pd.Series(rates, index=frame.index).astype(object)
            yield frame.assign(rate=found.where(~np.isnan(rates), None))[columns]
        if len(us):
            last = np.flatnonzero(np.append(series[1:] != series[:-1], True))
            keep = us >= us[last][series] - keep_us
            kept = np.bincount(series[keep], minlength=len(known)).tolist()
            state.update((list(known), kept, np.stack([us[keep], seq[keep], raw[keep]]).tobytes()))
            state.setTimeoutTimestamp((int(key[-1]) + slice_us) // 1000)

    spread = in_slices(rows.withColumn("_time", F.timestamp_micros("us")), window_us, slice_us, gate)
    asks = F.col("_slice").eqNullSafe(slice_start(F.col("us"), slice_us))
    needed = {"us", "seq", value}
    narrow = spread.select(
        *[F.col(c) if c in needed else F.when(asks, F.col(c)).alias(c) for c in rows.columns],
        F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])).alias("_series"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"),
        "_time", "_point", "_slice", asks.alias("_asks"),
    )
    return (
        narrow.withWatermark("_time", f"{lateness_seconds} seconds")
        .groupBy("_bucket", "_slice")
        .applyInPandasWithState(advance, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
