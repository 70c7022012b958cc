"""Global order without a one-task window: row positions and running sums over sorted data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylattice.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def with_prefix(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for every entry of `sums`, the total over all rows that sort before this row.

    Range-partitioned sort, then one total per range. The offsets table has one row per range,
    so its window and its broadcast are bounded by the number of shuffle partitions. The order
    must be total (no equal rows), so that a task that runs again numbers its rows alike.
    """
    columns = df.columns
    amounts = {f"_amount_{i}": expr for i, expr in enumerate(sums.values())}
    ranged = cut_lineage(
        df.orderBy(*order).select(
            "*",
            *[expr.alias(name) for name, expr in amounts.items()],
            F.monotonically_increasing_id().alias("_row"),
        )
    ).withColumn("_range", F.shiftright("_row", _LOCAL_BITS))

    before = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ranges_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*[F.sum(name).alias(name) for name in amounts])
        .select("_range", *[_running(name, ranges_before).alias(f"_offset{name}") for name in amounts])
    )
    local = ranged.select("*", *[_running(name, before).alias(f"_local{name}") for name in amounts])
    return local.join(F.broadcast(offsets), "_range").select(
        *columns,
        *[
            (F.col(f"_local{name}") + F.col(f"_offset{name}")).alias(target)
            for target, name in zip(sums, amounts)
        ],
    )


def _running(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0))


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Number the rows 0..n-1 in the given total order."""
    return with_prefix(df, order, {name: F.lit(1).cast("bigint")})
