"""Running sums and ranks of groups that no task need hold: sums by stretches of the order, then inside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], cut: Cut) -> DataFrame:
    """Adds for every name the sum up to and with the row, in `order` within `by`, and `<name>_all`, the group's.

    Rows are split by ranges of group and order and stored by `cut`, as splitting anew may draw other ranges; a table
    of a row a group and range (no more than groups and partitions together) carries the sums before each range.
    Rows of one order are in one range, so `order` should end with an id.  Null groups are groups.
    """
    ranged = cut(df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    keys = [f"__key{i}" for i in range(len(by))]
    held = ranged.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("__range").alias("__place")).agg(*[F.sum(f"__{n}").alias(f"__{n}_held") for n in sums])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        *keys, "__place", *[F.coalesce(F.sum(f"__{n}_held").over(before), F.lit(0)).alias(f"__{n}_before") for n in sums], *[F.sum(f"__{n}_held").over(whole).alias(f"{n}_all") for n in sums]
    )
    match = F.col("__range") == F.col("__place")
    for c, k in zip(by, keys):
        match &= F.col(c).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(held, match)
    return found.withColumns({n: F.col(f"__{n}_before") + F.sum(f"__{n}").over(inside) for n in sums}).select(*df.columns, *sums, *[f"{n}_all" for n in sums])


def ranked(df: DataFrame, by: list[str], order: list[Column], cut: Cut, name: str = "rank") -> DataFrame:
    """Adds the place of every row in its group, from 1, as `name`, and the group's size as `<name>_all`."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, cut)
