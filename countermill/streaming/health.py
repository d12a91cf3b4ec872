"""The health fold over a stream, one state row per device.

What a device's events add is worked out with array operations: running counts, the last event that
renewed the run of failures, the last success and its predecessor, the last message, and whether the
device is monitored. The same few values of the last event are the state, so a micro-batch continues
where the one before ended, and no event is visited on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from countermill.functions.health import success_rate
from countermill.functions.quality import status_name
from countermill.vocab import STATUS

STATE = (
    "present boolean, us bigint, total bigint, ok bigint, failures bigint, gap bigint, error string"
)
OUTPUT = (
    "device_id string, us bigint, seq bigint, kind string, status int, is_connected boolean, "
    "last_successful_read_us bigint, consecutive_failures bigint, last_error string, "
    "total_reads bigint, successful_reads bigint"
)
DAY_SECONDS = 86400


def last_at(marks: np.ndarray) -> np.ndarray:
    """For each place the last marked place up to it, -1 before the first."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def upto(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many marks there are up to each of these places; none up to -1."""
    return np.concatenate([[0], np.cumsum(marks)])[places + 1]


def fold(events: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Events of one device in order (us, seq, kind, success, error) and the state before them, to the
    emitted rows and the state after them."""
    present, at, total, ok, failures, gap, error = state
    kind = events["kind"].to_numpy(dtype=object)
    opens, closes = np.isin(kind, ["start", "add"]), np.isin(kind, ["remove", "stop"])
    change = last_at(opens | closes)
    before = np.concatenate([[-1], change[:-1]])
    was = np.where(before >= 0, opens[before], present)
    # A period opens for an absent device and ends for a present one; the rest needs a present device.
    events = events[np.where(opens, ~was, was)]
    present = bool(opens[change[-1]]) if change[-1] >= 0 else present
    if not len(events):
        return events.assign(**dict.fromkeys(_EMITTED)), (present, at, total, ok, failures, gap, error)

    kind = events["kind"].to_numpy(dtype=object)
    us = events["us"].to_numpy(dtype="int64")
    opens, closes, updates = np.isin(kind, ["start", "add"]), np.isin(kind, ["remove", "stop"]), kind == "update"
    reads = ~(opens | closes | updates)
    succeeded = reads & (events["success"].to_numpy(dtype=object) == True)  # noqa: E712 - missing is no success
    every = np.arange(len(events))
    opened = last_at(opens)
    carried = opened < 0

    renewed = last_at(opens | updates | succeeded)
    run = upto(reads, every) - upto(reads, renewed) + np.where(renewed < 0, failures, 0)
    reads_now = upto(reads, every) - np.where(carried, 0, upto(reads, opened)) + np.where(carried, total, 0)
    oks_now = upto(succeeded, every) - np.where(carried, 0, upto(succeeded, opened)) + np.where(carried, ok, 0)

    previous = np.concatenate([[np.nan if at is None else at], us[:-1].astype(float)])
    gaps = us - previous
    success = last_at(succeeded)
    own = success > opened
    gap_now = np.where(own, gaps[success], np.where(carried, np.nan if gap is None else gap, np.nan))

    said = last_at(~closes)
    own_error = np.where(reads & ~succeeded, events["error"].to_numpy(dtype=object), None)
    error_now = np.where(said >= 0, own_error[said], error)
    status = np.select(
        [succeeded, reads, closes], [STATUS["Online"], STATUS["Error"], STATUS["Offline"]], STATUS["Unknown"]
    )
    folded = events.assign(
        status=status.astype("int32"),
        is_connected=succeeded,
        last_successful_read_us=pd.array(gap_now, dtype="Float64").astype("Int64"),
        consecutive_failures=run,
        last_error=pd.Series(error_now, index=events.index, dtype=object),
        total_reads=reads_now,
        successful_reads=oks_now,
    )
    last = folded["last_successful_read_us"].iloc[-1]
    after = (
        present,
        int(us[-1]),
        int(reads_now[-1]),
        int(oks_now[-1]),
        int(run[-1]),
        None if pd.isna(last) else int(last),
        error_now[-1] if isinstance(error_now[-1], str) else None,
    )
    return folded[~np.isin(kind, ["start", "stop"])], after


_EMITTED = OUTPUT.replace(",", " ").split()[8::2]
ABSENT = (False, None, 0, 0, 0, None, None)


def stream_health(
    events: DataFrame,
    present_at_start: bool = True,
    start_us: int | None = None,
    forget_seconds: int = 7 * DAY_SECONDS,
) -> DataFrame:
    """Health of a device after each of its events, in update mode.

    Events of a micro-batch are folded in time order; what comes in a later batch is folded after them.
    Where devices have to be added first, a removed device leaves no state. Where they are present from
    the beginning, it leaves the fact that it is gone, without its counts, until the newest event is
    `forget_seconds` ahead of its removal; events that come later than that behind the newest one of
    earlier batches are left out there. Events without a time cannot be ordered and are left out here;
    `rejected_events` keeps them. Events without a device are folded as one device of their own.
    """
    names = OUTPUT.replace(",", " ").split()[::2]
    initial = (present_at_start, start_us, 0, 0, 0, None, None)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["us", "seq"], kind="stable")
        rows, now = fold(batch, tuple(state.get) if state.exists else initial)
        if now[0]:
            state.update(now)
        elif present_at_start:
            state.update(ABSENT)
            # The watermark is `forget_seconds` behind the newest event.
            state.setTimeoutTimestamp(max(int(batch["us"].iloc[-1]) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if len(rows):
            yield rows.assign(device_id=key[0])[names]

    narrow = events.filter(F.col("us").isNotNull()).select("device_id", "us", "seq", "kind", "success", "error")
    timeout = GroupStateTimeout.NoTimeout
    if present_at_start:
        timeout = GroupStateTimeout.EventTimeTimeout
        narrow = narrow.withColumn("_time", F.timestamp_micros("us")).withWatermark("_time", f"{forget_seconds} seconds")
    folded = narrow.groupBy("device_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", timeout)
    return folded.withColumn("status_name", status_name(F.col("status"))).withColumn(
        "success_rate", success_rate(F.col("total_reads"), F.col("successful_reads"))
    )
