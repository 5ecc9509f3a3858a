"""Running totals over the whole history of a key without having that history in one task: totals within blocks of time,
and on top of each the total of all blocks before it, which is one row for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], width: int, tops: dict[str, Column] | None = None, own: bool = True) -> DataFrame:
    """Adds the running sums `sums` and running maxima `tops` (name: value) along `order`, whose first column is a time in a
    long. own: the row itself included. Without a row before it a sum is 0 and a maximum null. `rows` is read twice."""
    tops = tops or {}
    cut = rows.withColumn("_block", F.floor(F.col(order[0]) / width).cast("long"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    near = cut.select("*", *[F.sum(x).over(inside).alias(f"_in_{n}") for n, x in sums.items()], *[F.max(x).over(inside).alias(f"_in_{n}") for n, x in tops.items()])
    blocks = cut.groupBy(*by, "_block").agg(*[F.sum(x).alias(n) for n, x in sums.items()], *[F.max(x).alias(n) for n, x in tops.items()])
    past = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*by, "_block", *[F.sum(n).over(past).alias(f"_up_{n}") for n in sums], *[F.max(n).over(past).alias(f"_up_{n}") for n in tops])
    joined = near.join(base, [*by, "_block"], "left")
    total = lambda n: F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_up_{n}", F.lit(0))
    return joined.select(*rows.columns, *[total(n).alias(n) for n in sums], *[F.greatest(f"_in_{n}", f"_up_{n}").alias(n) for n in tops])
