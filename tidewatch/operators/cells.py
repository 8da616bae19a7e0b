"""Ordered computations per key that never put a whole key into one task.

A plain window partitioned by user makes one task of each user, so a user with a third of all rows stalls the
job; and a trailing RANGE frame re-reads its rows for every row. Here each key's time line is cut into cells of a
fixed width. Work inside a cell runs as a window over (key, cell) with running frames only, so it is linear after
the sort. What earlier cells contribute is a small table, one row per (key, cell), scanned per key and joined back
on the same (key, cell) partitioning. The cell width bounds the rows of one task; results do not depend on it.

A row without a key or a time has no place on a time line: it passes through with nulls in the added columns, and no
other row sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

_START, _NOW, _END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def cell_of(ts: Column, cell_ms: int) -> Column:
    return F.floor(ts / F.lit(cell_ms))


def placed_rows(df: DataFrame, keys: list[str], ts: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a place on a time line, and the others."""
    known = F.col(ts).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return df.filter(known), df.filter(~known)


def running_totals(df: DataFrame, keys: list[str], cell: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (current row included) along ``order``, which must agree with the order of ``cell``.

    ``keys`` may be empty: then it is one running sum over the whole table, and the only table that is scanned in
    one task is the one with a row per cell.
    """
    with_values = df.select("*", *[v.alias(f"_v_{name}") for name, v in sums.items()])
    upto = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(_START, _NOW)
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(_START, -1)
    carry = (
        with_values.groupBy(*keys, cell)
        .agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
        .select(*keys, cell, *[F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums])
    )
    inside = with_values.select("*", *[F.sum(f"_v_{name}").over(upto).alias(f"_r_{name}") for name in sums])
    return inside.join(carry, [*keys, cell]).select(
        *df.columns,
        *[(F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def running_maximum(
    df: DataFrame, keys: list[str], cell: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds the running maximum (current row included) along ``order``."""
    with_value = df.withColumn("_v", value)
    upto = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(_START, _NOW)
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(_START, -1)
    carry = (
        with_value.groupBy(*keys, cell)
        .agg(F.max("_v").alias("_t"))
        .select(*keys, cell, F.max("_t").over(before).alias("_c"))
    )
    inside = with_value.withColumn("_r", F.max("_v").over(upto))
    return inside.join(carry, [*keys, cell]).select(*df.columns, F.greatest("_r", "_c").alias(name))


def previous_row(
    df: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], cell_ms: int = DAY_MS
) -> DataFrame:
    """Adds ``prev_<column>``: the value in the row before, per key in order of (ts, tie); null for the first."""
    placed, others = placed_rows(df, keys, ts)
    cut = placed.withColumn("_cell", cell_of(F.col(ts), cell_ms))
    inside = Window.partitionBy(*keys, "_cell").orderBy(ts, tie)
    over_cells = Window.partitionBy(*keys).orderBy("_cell")
    image = F.struct(ts, tie, *[F.col(c).alias(f"_p_{c}") for c in columns])
    carry = (
        cut.groupBy(*keys, "_cell")
        .agg(F.max(image).alias("_last"))
        .select(*keys, "_cell", F.lag("_last").over(over_cells).alias("_carry"))
    )
    found = (
        cut.withColumn("_first", F.row_number().over(inside) == 1)
        .select("*", *[F.lag(c).over(inside).alias(f"_in_{c}") for c in columns])
        .join(carry, [*keys, "_cell"])
        .select(
            *df.columns,
            *[
                F.when(F.col("_first"), F.col(f"_carry._p_{c}")).otherwise(F.col(f"_in_{c}")).alias(f"prev_{c}")
                for c in columns
            ],
        )
    )
    return found.unionByName(others, allowMissingColumns=True)


def neighbour_times(df: DataFrame, keys: list[str], ts: str, tie: str, cell_ms: int = DAY_MS) -> DataFrame:
    """Adds ``prev_ts`` and ``next_ts``: the times of the rows before and after within the key."""
    placed, others = placed_rows(df, keys, ts)
    cut = placed.withColumn("_cell", cell_of(F.col(ts), cell_ms))
    inside = Window.partitionBy(*keys, "_cell").orderBy(ts, tie)
    over_cells = Window.partitionBy(*keys).orderBy("_cell")
    carry = (
        cut.groupBy(*keys, "_cell")
        .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        .select(
            *keys,
            "_cell",
            F.lag("_hi").over(over_cells).alias("_carry_prev"),
            F.lead("_lo").over(over_cells).alias("_carry_next"),
        )
    )
    found = (
        cut.select("*", F.lag(ts).over(inside).alias("_prev"), F.lead(ts).over(inside).alias("_next"))
        .join(carry, [*keys, "_cell"])
        .select(
            *df.columns,
            F.coalesce("_prev", "_carry_prev").alias("prev_ts"),
            F.coalesce("_next", "_carry_next").alias("next_ts"),
        )
    )
    return found.unionByName(others, allowMissingColumns=True)


def run_position(df: DataFrame, key: str, ts: str, tie: str, gap_ms: int, name: str, cell_ms: int = HOUR_MS) -> DataFrame:
    """Adds the position (from 1) of a row in its run: a run ends when the next row is more than ``gap_ms`` later."""
    placed, others = placed_rows(df, [key], ts)
    cut = placed.withColumn("_cell", cell_of(F.col(ts), cell_ms))
    inside = Window.partitionBy(key, "_cell").orderBy(ts, tie)
    cut = cut.select(
        "*",
        F.row_number().over(inside).alias("_n"),
        (F.col(ts) - F.lag(ts).over(inside) > gap_ms).alias("_begins"),
    )
    # position inside the cell where the current run began; null while the run came in from an earlier cell
    cut = cut.withColumn("_begin_n", F.max(F.when(F.col("_begins"), F.col("_n"))).over(inside.rowsBetween(_START, _NOW)))

    cells = cut.groupBy(key, "_cell").agg(
        F.max("_n").alias("_size"),
        F.max("_begin_n").alias("_last_begin"),
        F.min(ts).alias("_lo"),
        F.max(ts).alias("_hi"),
    )
    over_cells = Window.partitionBy(key).orderBy("_cell")
    cells = cells.select(
        key,
        "_cell",
        (F.col("_size") - F.coalesce(F.col("_last_begin") - 1, F.lit(0))).alias("_tail"),
        F.col("_last_begin").isNotNull().alias("_breaks"),
        F.coalesce(F.col("_lo") - F.lag("_hi").over(over_cells) <= gap_ms, F.lit(False)).alias("_joined"),
    )
    cells = cells.withColumn("_tails", F.sum("_tail").over(over_cells.rowsBetween(_START, _NOW)))
    origin = F.when(F.col("_breaks") | ~F.col("_joined"), F.col("_tails") - F.col("_tail"))
    cells = cells.withColumn("_base", F.max(origin).over(over_cells.rowsBetween(_START, _NOW)))
    cells = cells.withColumn("_carry", F.lag(F.col("_tails") - F.col("_base")).over(over_cells))
    # only cells that go on with a run have anything to carry, often few of them
    carry = cells.filter("_joined").select(key, "_cell", "_carry")
    position = F.coalesce(F.col("_n") - F.col("_begin_n") + 1, F.col("_n") + F.coalesce(F.col("_carry"), F.lit(0)))
    found = cut.join(carry, [key, "_cell"], "left").select(*df.columns, position.cast("long").alias(name))
    return found.unionByName(others, allowMissingColumns=True)


def trailing(
    df: DataFrame,
    key: str,
    sums: dict[str, tuple[int, Column]],
    ts: str = "ts_ms",
    tie: str = "tx_id",
    cell_ms: int = HOUR_MS,
    include_current: bool = True,
) -> DataFrame:
    """Adds sums over (t - horizon, t] per key, for any number of horizons in one shuffle.

    Every row enters the running sum when it happens and leaves it ``horizon`` later, so a trailing sum is one
    running sum over arrivals and departures. Rows are taken one at a time in order of (ts, tie): of two rows with
    the same time the first does not see the second. Values must be integers, so that leaving undoes entering.
    ``include_current=False`` takes the row's own value out again. Rows without a key or a time get nulls.
    """
    horizons = sorted({h for h, _ in sums.values()})
    keyed, others = placed_rows(df, [key], ts)
    values = keyed.select("*", *[F.coalesce(v, F.lit(0)).cast("long").alias(f"_x_{n}") for n, (_, v) in sums.items()])

    def moment(kind: int, at: Column, sign: dict[str, int]) -> Column:
        return F.struct(
            at.cast("long").alias("_at"),
            F.lit(kind).alias("_kind"),
            *[(F.col(f"_x_{n}") * F.lit(sign[n])).cast("long").alias(f"_d_{n}") for n in sums],
        )

    arrive = moment(1, F.col(ts), {n: 1 for n in sums})
    leave = [
        moment(0, F.col(ts) + F.lit(h), {n: -1 if own == h else 0 for n, (own, _) in sums.items()}) for h in horizons
    ]
    moments = values.select(
        F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"), F.explode(F.array(arrive, *leave)).alias("_m")
    ).select("_key", "_m.*", F.when(F.col("_m._kind") == 1, F.col("_row")).alias("_row"))
    moments = moments.withColumn("_cell", cell_of(F.col("_at"), cell_ms))
    order = [F.col("_at"), F.col("_kind"), F.col(f"_row.{tie}")]
    out = running_totals(moments, ["_key"], "_cell", order, {n: F.col(f"_d_{n}") for n in sums})
    own = {n: F.lit(0) if include_current else F.col(f"_d_{n}") for n in sums}
    result = out.filter("_kind = 1").select("_row.*", *[(F.col(n) - own[n]).alias(n) for n in sums])
    return result.unionByName(others, allowMissingColumns=True)


def trailing_max(
    df: DataFrame,
    key: str,
    value: str,
    horizon_ms: int,
    name: str,
    ts: str = "ts_ms",
    tie: str = "tx_id",
    cell_ms: int = HOUR_MS,
) -> DataFrame:
    """Adds the maximum over (t - horizon, t] per key; the cell width must divide the horizon.

    The window of a row is the end of one old cell, the whole cells after it, and the beginning of the row's own cell.
    Old rows meet the new ones at the time they drop out, so the end of the old cell is a running maximum backwards.
    """
    if horizon_ms % cell_ms:
        raise ValueError("the cell width must divide the horizon")
    whole_cells = horizon_ms // cell_ms - 1
    keyed, others = placed_rows(df, [key], ts)
    rows = keyed.select(
        F.col(key).alias("_key"),
        F.col(value).alias("_value"),
        F.struct(*df.columns).alias("_row"),
        F.explode(
            F.array(
                F.struct(F.col(ts).alias("_at"), F.lit(1).alias("_kind")),
                F.struct((F.col(ts) + horizon_ms).alias("_at"), F.lit(0).alias("_kind")),
            )
        ).alias("_m"),
    ).select("_key", "_value", "_m.*", F.when(F.col("_m._kind") == 1, F.col("_row")).alias("_row"))
    rows = rows.withColumn("_cell", cell_of(F.col("_at"), cell_ms))
    cell = Window.partitionBy("_key", "_cell")
    upto = cell.orderBy("_at", "_kind", f"_row.{tie}").rowsBetween(_START, _NOW)
    back = cell.orderBy(F.desc("_at"), F.desc("_kind"), F.desc(f"_row.{tie}")).rowsBetween(_START, _NOW)
    rows = rows.withColumn("_old", F.max(F.when(F.col("_kind") == 0, F.col("_value"))).over(back))
    rows = rows.withColumn("_new", F.max(F.when(F.col("_kind") == 1, F.col("_value"))).over(upto)).filter("_kind = 1")
    parts = ["_old", "_new"]
    if whole_cells:
        between = Window.partitionBy("_key").orderBy("_cell").rangeBetween(-whole_cells, -1)
        carry = (
            keyed.groupBy(F.col(key).alias("_key"), cell_of(F.col(ts), cell_ms).alias("_cell"))
            .agg(F.max(value).alias("_top"))
            .select("_key", "_cell", F.max("_top").over(between).alias("_between"))
        )
        rows = rows.join(carry, ["_key", "_cell"])
        parts.append("_between")
    out = rows.select("_row.*", F.greatest(*parts).alias(name))
    return out.unionByName(others, allowMissingColumns=True)


def trailing_distinct(
    df: DataFrame,
    key: str,
    value: str,
    horizon_ms: int,
    name: str,
    ts: str = "ts_ms",
    tie: str = "tx_id",
    cell_ms: int = HOUR_MS,
) -> DataFrame:
    """Adds the number of distinct non-null values over (t - horizon, t] per key.

    A value counts from a row that finds no earlier one inside the horizon until the horizon has passed since a row
    that no later one follows inside it. So the distinct count is a running sum of such starts and ends, and no
    set of values is ever collected.
    """
    # the cells of (key, value) need not be as fine as those of the key
    keyed, others = placed_rows(df, [key], ts)
    keyed = keyed.withColumn("_value", F.coalesce(F.col(value).cast("string"), F.lit("")))
    near = neighbour_times(keyed, [key, "_value"], ts, tie, max(cell_ms, DAY_MS))
    present = F.col(value).isNotNull()
    starts = present & (F.col("prev_ts").isNull() | (F.col(ts) - F.col("prev_ts") >= horizon_ms))
    ends = present & (F.col("next_ts").isNull() | (F.col("next_ts") - F.col(ts) >= horizon_ms))
    moments = near.select(
        F.col(key).alias("_key"),
        F.struct(*df.columns).alias("_row"),
        F.explode(
            F.array(
                F.struct(F.col(ts).cast("long").alias("_at"), F.lit(1).alias("_kind"), starts.cast("long").alias("_d")),
                F.struct(
                    (F.col(ts) + horizon_ms).cast("long").alias("_at"),
                    F.lit(0).alias("_kind"),
                    (-ends.cast("long")).alias("_d"),
                ),
            )
        ).alias("_m"),
    ).select("_key", "_m.*", F.when(F.col("_m._kind") == 1, F.col("_row")).alias("_row"))
    moments = moments.filter("_kind = 1 OR _d <> 0").withColumn("_cell", cell_of(F.col("_at"), cell_ms))
    order = [F.col("_at"), F.col("_kind"), F.col(f"_row.{tie}")]
    out = running_totals(moments, ["_key"], "_cell", order, {name: F.col("_d")})
    result = out.filter("_kind = 1").select("_row.*", name)
    return result.unionByName(others, allowMissingColumns=True)
