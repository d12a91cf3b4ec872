"""Ordered work over long series, cut into time slices.

A window over a whole series puts every row of one busy device into one task. The helpers here
partition by key *and* time slice instead, so that a hot series spreads over as many tasks as it
has slices, and bring in what a slice needs from outside it:

* a short frame needs only the rows shortly before the slice (`with_oldest` copies them over);
* a long or unbounded one needs one summary row per slice (`fill_forward` carries it along), taken
  from the rows of the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countermill.vocab import DAY_US, HOUR_US


def slice_start(us: Column, width_us: int) -> Column:
    """Start of the time slice that holds `us`, in whole microseconds."""
    return us - F.pmod(us, F.lit(width_us).cast("bigint"))


def with_oldest(
    df: DataFrame,
    keys: list[str],
    value: str,
    window_us: int | Column,
    inclusive: bool = True,
    gate: Column | None = None,
    us: str = "us",
    seq: str = "seq",
    slice_us: int | None = None,
) -> DataFrame:
    """Add `oldest`: the first (us, seq, value) within the window that ends at each row.

    Each row asks for the first point at or after `us - window`. Points and questions of a slice
    are sorted together, newest first, and the last point passed is the answer. That sorts once
    whatever the number of points per window, where a sliding RANGE frame would rescan the frame
    for every row.

    Slices as wide as the window or wider get the points they share with the next slice copied
    over. Narrower slices, the choice for windows of more than an hour, carry one summary row per
    slice instead, so the width of the window does not limit how finely a busy series is cut. That is
    also the way where `window_us` is a column and every row has a window of its own: a question stands
    at its own time less its own window, so one sort answers all of them. A NULL window is an empty one.

    Rows whose `gate` is false are no points and get no answer of their own.
    """
    own_windows = isinstance(window_us, Column)
    if slice_us is None:
        slice_us = 4 * window_us if not own_windows and window_us <= HOUR_US else HOUR_US
    gate = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    window = F.coalesce(window_us, F.lit(0)).cast("bigint") if own_windows else F.lit(window_us).cast("bigint")
    # Only the asking copy of a row carries its other columns through the shuffle and the sort.
    needed = [*keys, us, seq, value]

    def slim(carrier: Column) -> list[Column]:
        return [F.col(c) if c in needed else F.when(carrier, F.col(c)).alias(c) for c in df.columns]

    def with_roles(rows: DataFrame, asks: Column) -> DataFrame:
        """A row as a point (0), a question (1) or both; `_at` is the time it stands for."""
        both, point_only, ask_only = F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)), F.array(F.lit(1))
        role = F.when(F.col("_gate") & asks, both).when(F.col("_gate"), point_only).when(asks, ask_only)
        reach = window - F.lit(0 if inclusive else 1)
        kept = [c for c in rows.columns if c not in df.columns]
        return rows.withColumn("_role", F.explode(role)).select(
            *slim(F.col("_role") == 1),
            *kept,
            "_role",
            F.when(F.col("_role") == 1, F.col(us) - reach).otherwise(F.col(us)).alias("_at"),
        )

    point = F.when(
        F.col("_role") == 0,
        F.struct(F.col(us).alias("us"), F.col(seq).alias("seq"), F.col(value).alias("value")),
    )
    gated = df.withColumn("_gate", gate)

    if own_windows or slice_us < window_us:
        backwards = with_roles(gated, F.lit(True)).withColumns({"_back": -F.col("_at"), "_last": -F.col(seq)})
        found = fill_forward(backwards, keys, {"_found": point}, ["_back", "_role", "_last"], slice_us=slice_us)
    else:
        home = slice_start(F.col(us), slice_us)
        following = home + F.lit(slice_us).cast("bigint")
        # A point within the last window of a slice may be the oldest one of a row in the next slice.
        reaches_next = F.col("_gate") & (F.col(us) >= following - F.lit(window_us))
        copies = gated.withColumn(
            "_slice", F.explode(F.when(reaches_next, F.array(home, following)).otherwise(F.array(home)))
        )
        asks = F.col("_slice").eqNullSafe(home)  # a row without a time still asks, and gets no answer
        spread = copies.select(*slim(asks), "_gate", "_slice", asks.alias("_asks")).repartition(*keys, "_slice")
        newest_first = (
            Window.partitionBy(*keys, "_slice")
            .orderBy(F.col("_at").desc(), F.col("_role").asc(), F.col(seq).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        found = with_roles(spread, F.col("_asks")).withColumn(
            "_found", F.last(point, ignorenulls=True).over(newest_first)
        )
    return found.filter(F.col("_role") == 1).select(
        *df.columns, F.when(F.col("_gate"), F.col("_found")).alias("oldest")
    )


def by_key_and_slice(df: DataFrame, keys: list[str], us: str, slice_us: int) -> DataFrame:
    """Rows with `_key`, the key columns as one value that is never null, in their place, and `_slice`."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias("_key"), *rest, slice_start(F.col(us), slice_us).alias("_slice"))


def whole_row_order(df: DataFrame, order: list[str]) -> list[Column]:
    """An order by these columns, ties by the rest of the row as far as it can be compared.

    It settles ties the same way every time, and it makes a window over the rows need all of them:
    plans that read the rows twice then ask their shuffle for the same columns, and Spark makes it once.
    """
    settled = {*order, "_key", "_slice"}
    rest = [f.name for f in df.schema.fields if f.name not in settled and _comparable(f.dataType)]
    return [*map(F.col, order), *map(F.col, rest)]


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def fill_forward(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, Column],
    order: list[str] = ["us", "seq"],
    inclusive: bool = True,
    slice_us: int = DAY_US,
    keep_slice: bool = False,
) -> DataFrame:
    """Add, per name, the last non-null value of a column at (or strictly before) each row.

    The first name in `order` must be the time in microseconds. The rows are shuffled once, by key and
    time slice, and put into order by a running window. The last row of a slice holds what the slice
    passes on, so its summary comes from the same sorted rows without moving them again; one summary row
    per slice is carried along by a short window and joined back to its slice.

    Rows without a time stay, get nothing and pass nothing on. Null keys are keys of their own. With
    `keep_slice` the rows keep `_key` and `_slice`, and work by them goes on without another shuffle.
    """
    cut = by_key_and_slice(df, keys, order[0], slice_us)
    timed = F.col("_slice").isNotNull()
    values = {n: F.when(timed & c.isNotNull(), F.struct(c.alias("v"))).alias(f"_v_{n}") for n, c in columns.items()}
    spread = cut.select("*", *values.values()).repartition("_key", "_slice")

    in_slice = Window.partitionBy("_key", "_slice").orderBy(*whole_row_order(spread, order))
    upto = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = upto if inclusive else in_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.last(f"_v_{n}", ignorenulls=True) for n in columns}
    inside = spread.select("*", *[value.over(before).alias(f"_s_{n}") for n, value in carried.items()])

    last_rows = spread.select(
        "_key",
        "_slice",
        F.lead(F.lit(True)).over(in_slice).alias("_more"),
        *[value.over(upto).alias(f"_e_{n}") for n, value in carried.items()],
    ).filter(F.col("_more").isNull())
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entering = last_rows.select(
        "_key", "_slice", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in columns]
    )
    return inside.join(entering, ["_key", "_slice"], "left").select(
        *[F.col("_key")[c].alias(c) if c in keys else F.col(c) for c in df.columns if c not in columns],
        *(["_key", "_slice"] if keep_slice else []),
        *[F.coalesce(F.col(f"_s_{n}"), F.col(f"_in_{n}"))["v"].alias(n) for n in columns],
    )
