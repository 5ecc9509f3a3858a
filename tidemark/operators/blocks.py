"""Windows of bounded time over a hot key: time is cut into blocks as long as the window, and every row also stands, as a
ghost, in the block after its own. A window then needs its own block only, so that one key's history is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def blocked(rows: DataFrame, by: list[str], time: str, width: int, least: int = 0) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows twice (`_own`: the real ones, to be kept once windows are worked out), the window of the `width` before each row
    and up to `least` before it (0: its own time included; 1: what is earlier), and a row's time since its block began
    (below 0 for ghosts). Windows must be no longer than `width`."""
    block = F.floor(F.col(time) / width).cast("long")
    twice = rows.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_block", block + F.col("_shift"))
    twice = twice.withColumn("_own", F.col("_shift") == 0).drop("_shift")
    w = Window.partitionBy(*by, "_block").orderBy(time).rangeBetween(-width, -least)
    return twice, w, (F.col(time) - F.col("_block") * F.lit(width)).cast("double")


def blocked_sum(value: Column, by: list[str], time: str, width: int, least: int = 0) -> Column:
    """Sum of `value` over the window of `blocked` (least: 0 or 1), for its own rows; null where all values are. A frame that
    moves at both ends is summed anew at every row. Here one sum grows upwards, over the block, and one downwards, over the
    ghosts, so every row is added once; and nothing is subtracted, so doubles lose no digits."""
    block, own = Window.partitionBy(*by, "_block"), F.col("_own")
    near = F.sum(F.when(own, value)).over(block.orderBy(time).rangeBetween(Window.unboundedPreceding, -least))
    far = F.sum(F.when(~own, value)).over(block.orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, width))
    return F.coalesce(near + far, near, far)
