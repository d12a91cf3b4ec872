"""Device health from the success and failure of polls and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countermill.functions.health import health_score, success_rate
from countermill.functions.quality import status_name
from countermill.operators.slices import by_key_and_slice, fill_forward, whole_row_order
from countermill.vocab import HOUR_US, STATUS

LIFECYCLE = ["start", "add", "update", "remove", "stop"]


def health_events(
    polls: DataFrame, probes: DataFrame | None = None, lifecycle: DataFrame | None = None
) -> DataFrame:
    """One ordered log of channel reads, connection probes and device changes.

    All channels of a device cycle share one poll time but health is updated after each read, so
    the time of an update is the poll time plus the read durations of the cycle so far. A cycle
    holds one row per channel of one device.
    """
    cycle = Window.partitionBy("device_id", "us").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reads = polls.select(
        "device_id",
        (F.col("us") + F.sum(F.coalesce("acquisition_us", F.lit(0))).over(cycle)).alias("us"),
        "seq",
        F.lit("read").alias("kind"),
        (F.col("success") & F.col("registers").isNotNull()).alias("success"),
        "error",
    )
    log = reads
    if probes is not None:
        log = log.unionByName(
            probes.select("device_id", "us", "seq", F.lit("probe").alias("kind"), "success", "error")
        )
    if lifecycle is not None:
        none = F.lit(None)
        log = log.unionByName(
            lifecycle.select(
                "device_id", "us", "seq", "kind", none.cast("boolean").alias("success"), none.cast("string").alias("error")
            )
        )
    return log


def rejected_events(events: DataFrame) -> DataFrame:
    """Events that no health can be worked out from, as they are, with the reason: without a time an event
    has no place in the order of its device. Every other event, one without a device included, is folded."""
    return events.filter(F.col("us").isNull()).withColumn("reason", F.lit("no_time"))


def monitored(events: DataFrame, present_at_start: bool = True, slice_us: int = HOUR_US) -> DataFrame:
    """Events that count: reads, probes and updates of a present device, and the changes that take effect.

    A period starts with a start or add event of an absent device and ends with remove or stop. Adding
    a present device, removing or updating an absent one are refused, and reads of an absent device are
    ignored. What a change does depends on the kind of the change before it only, so that one value is
    carried from slice to slice. The rows keep `_key` and `_slice`.
    """
    opens = F.col("kind").isin("start", "add")
    closes = F.col("kind").isin("remove", "stop")
    before = fill_forward(
        events,
        ["device_id"],
        {"_was": F.when(opens | closes, opens)},
        inclusive=False,
        slice_us=slice_us,
        keep_slice=True,
    )
    was = F.coalesce("_was", F.lit(present_at_start))
    return before.filter(F.col("us").isNotNull() & (opens != was)).drop("_was")


def health_fold(
    events: DataFrame, keys: list[str] = ["device_id"], start_us: int | None = None, slice_us: int = HOUR_US
) -> DataFrame:
    """State of each device after every event, as one row per event.

    Start and add events begin the counts anew. The running counts of a slice are windows; what enters
    a slice is a running sum over one summary row per earlier slice, which is the last row of that slice.
    All of it reads one shuffle on (keys, slice). Events without a time are left out, see
    `rejected_events`; null keys are keys of their own. Events that already carry `_key` and `_slice` are
    not shuffled again.
    """
    seed = F.lit(start_us).cast("bigint")
    reads = F.col("kind").isin("read", "probe")
    fresh = F.col("kind").isin("start", "add")
    succeeded = reads & F.coalesce("success", F.lit(False))
    renews = succeeded | F.col("kind").isin("start", "add", "update")
    own_error = F.struct(F.when(~succeeded, F.col("error")).alias("error"))
    if "_slice" in events.columns:
        spread = events.drop(*keys)
    else:
        cut = by_key_and_slice(events, keys, "us", slice_us)
        spread = cut.filter(F.col("_slice").isNotNull()).repartition("_key", "_slice")

    upto = Window.partitionBy("_key", "_slice").orderBy(*whole_row_order(spread, ["us", "seq"]))
    running = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = spread.select(
        "*",
        F.sum(reads.cast("bigint")).over(running).alias("_reads"),
        F.sum(succeeded.cast("bigint")).over(running).alias("_oks"),
        F.lag("us").over(upto).alias("_prev"),
        F.lead(F.lit(True)).over(upto).alias("_more"),
        F.last(F.when(F.col("kind") != "remove", own_error), True).over(running).alias("_err"),
    )
    at_fresh = F.struct(F.col("us"), F.col("seq"), F.col("_reads").alias("reads"), F.col("_oks").alias("oks"))
    no_success = F.struct(F.lit(None).cast("bigint").alias("us"), F.lit(None).cast("bigint").alias("prev"))
    inside = counted.select(
        "*",
        F.max(F.when(renews, F.col("_reads"))).over(running).alias("_renewed"),
        F.last(F.when(fresh, at_fresh), True).over(running).alias("_fresh"),
        F.last(F.when(succeeded, F.struct("us", F.col("_prev").alias("prev"))).when(fresh, no_success), True)
        .over(running)
        .alias("_ok"),
    )

    ends = inside.filter(F.col("_more").isNull())
    order = Window.partitionBy("_key").orderBy("_slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sums over all earlier slices, and what they were when the counts last began anew.
    sums = (
        ends.withColumn("sum_n", F.sum("_reads").over(through) - F.col("_reads"))
        .withColumn("sum_k", F.sum("_oks").over(through) - F.col("_oks"))
        .withColumn("prev_in", F.coalesce(F.last("us").over(earlier), seed))
    )
    begun = F.struct(
        F.col("_fresh")["us"].alias("us"),
        F.col("_fresh")["seq"].alias("seq"),
        (F.col("sum_n") + F.col("_fresh")["reads"]).alias("n"),
        (F.col("sum_k") + F.col("_fresh")["oks"]).alias("k"),
    )
    gap = F.struct((F.col("_ok")["us"] - F.coalesce(F.col("_ok")["prev"], F.col("prev_in"))).alias("gap"))
    entering = sums.select(
        "_key",
        "_slice",
        "sum_n",
        "sum_k",
        "prev_in",
        F.last(F.when(F.col("_fresh").isNotNull(), begun), True).over(earlier).alias("fresh_in"),
        (F.col("sum_n") - F.coalesce(F.max(F.col("sum_n") + F.col("_renewed")).over(earlier), F.lit(0))).alias("run_in"),
        F.last(F.when(F.col("_ok").isNotNull(), gap), True).over(earlier)["gap"].alias("gap_in"),
        F.last("_err", True).over(earlier).alias("err_in"),
    )

    own = F.col("_fresh").isNotNull()
    since = {name: F.coalesce(F.col("fresh_in")[name], F.lit(0)) for name in ("n", "k")}
    total = F.when(own, F.col("_reads") - F.col("_fresh")["reads"]).otherwise(F.col("sum_n") + F.col("_reads") - since["n"])
    ok = F.when(own, F.col("_oks") - F.col("_fresh")["oks"]).otherwise(F.col("sum_k") + F.col("_oks") - since["k"])
    run = F.when(F.col("_renewed").isNotNull(), F.col("_reads") - F.col("_renewed")).otherwise(
        F.col("run_in") + F.col("_reads")
    )
    last_gap = F.when(
        F.col("_ok").isNotNull(), F.col("_ok")["us"] - F.coalesce(F.col("_ok")["prev"], F.col("prev_in"))
    ).otherwise(F.col("gap_in"))
    status = (
        F.when(succeeded, F.lit(STATUS["Online"]))
        .when(reads, F.lit(STATUS["Error"]))
        .when(F.col("kind") == "remove", F.lit(STATUS["Offline"]))
        .otherwise(F.lit(STATUS["Unknown"]))
    )
    error = F.coalesce("_err", "err_in")["error"]
    return inside.join(entering, ["_key", "_slice"], "left").select(
        *[F.col("_key")[k].alias(k) for k in keys],
        "us",
        F.timestamp_micros("us").alias("ts"),
        "seq",
        "kind",
        status.alias("status"),
        status_name(status).alias("status_name"),
        succeeded.alias("is_connected"),
        last_gap.alias("last_successful_read_us"),
        run.alias("consecutive_failures"),
        F.lit(None).cast("double").alias("communication_latency"),
        F.when(succeeded, F.lit(None)).otherwise(error).alias("last_error"),
        total.alias("total_reads"),
        ok.alias("successful_reads"),
        success_rate(total, ok).alias("success_rate"),
        F.coalesce(F.col("_fresh")["us"], F.col("fresh_in")["us"]).alias("epoch_us"),
        F.coalesce(F.col("_fresh")["seq"], F.col("fresh_in")["seq"]).alias("epoch_seq"),
    )


def health_history(events: DataFrame, start_us: int | None = None, slice_us: int = HOUR_US) -> DataFrame:
    """Health after every read or probe of devices that are never added or removed."""
    return health_fold(events, start_us=start_us, slice_us=slice_us).drop("epoch_us", "epoch_seq")


def last_successful_read(events: DataFrame, start_us: int | None = None, slice_us: int = HOUR_US) -> DataFrame:
    """Time between each success and the update before it, carried over failures."""
    return health_history(events, start_us, slice_us).select(
        "device_id", "us", "seq", "is_connected", "last_successful_read_us"
    )


def health_epochs(
    events: DataFrame, present_at_start: bool = True, start_us: int | None = None, slice_us: int = HOUR_US
) -> DataFrame:
    """Health with devices added, updated and removed on the way.

    Every change but the initial start and the final stop emits a row. `epoch_us` and `epoch_seq` are
    the event that began the period; a device present from the beginning has none, so its period is
    numbered by the start.
    """
    folded = health_fold(monitored(events, present_at_start, slice_us), start_us=start_us, slice_us=slice_us)
    return (
        folded.filter(~F.col("kind").isin("start", "stop"))
        .withColumn("epoch_us", F.coalesce("epoch_us", F.lit(start_us or 0).cast("bigint")))
        .withColumn("epoch_seq", F.coalesce("epoch_seq", F.lit(-1).cast("bigint")))
    )


def latest_per_device(health: DataFrame, device_id: str | None = None) -> DataFrame:
    """Current row of each device, or of one."""
    rows = health if device_id is None else health.filter(F.col("device_id") == device_id)
    values = [c for c in rows.columns if c != "device_id"]
    latest = rows.groupBy("device_id").agg(F.max_by(F.struct(*values), F.struct("us", "seq")).alias("_h"))
    return latest.select("device_id", "_h.*")


def service_health(latest: DataFrame, running: bool | Column = True) -> DataFrame:
    """One row: how many devices are online, with the service state and its text."""
    counts = latest.agg(
        F.count_if(F.col("status") == STATUS["Online"]).alias("online"), F.count(F.lit(1)).alias("total")
    )
    live = running if isinstance(running, Column) else F.lit(running)
    online, total = F.col("online"), F.col("total")
    share = F.concat(F.lit("("), online, F.lit("/"), total, F.lit(")"))
    # The state names and texts of the service report.
    state = (
        F.when(~live, F.lit("Unhealthy"))
        .when(online == 0, F.lit("Unhealthy"))
        .when(online < total, F.lit("Degraded"))
        .otherwise(F.lit("Healthy"))
    )
    text = (
        F.when(~live, F.lit("Service is not running"))
        .when(online == 0, F.concat(F.lit("No devices are online "), share))
        .when(online < total, F.concat(F.lit("Some devices are offline "), share))
        .otherwise(F.concat(F.lit("All devices are online "), share))
    )
    return counts.select(state.alias("state"), text.alias("description"), "online", "total")


def device_health_summary(health: DataFrame) -> DataFrame:
    """Per device: current state, totals and score."""
    return latest_per_device(health).select(
        "device_id",
        "status",
        "is_connected",
        "last_successful_read_us",
        "total_reads",
        "consecutive_failures",
        health_score(F.col("total_reads"), F.col("successful_reads"), F.col("consecutive_failures")).alias(
            "health_score"
        ),
    )
