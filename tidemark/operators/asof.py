"""As-of joins without a join: both sides are tagged, united, and sorted together.

Time is cut into buckets, so that a hot key is spread over tasks: within (key, bucket) the last right row is carried by a
window, and what was last before the bucket comes from one row for each bucket. Only that small table is scanned by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, by: list[str], left_time: Column, right_time: Column, right_order: list[str], take: dict[str, str], width: int, forward: bool = False, equal: bool = True
) -> DataFrame:
    """Adds to each left row, as the columns `take` (name on the left: name on the right), those of the last right row with
    right_time <= left_time (forward: the first with >=); with equal=False, < and >. Rows of the right with equal times are
    ordered by right_order. Left rows without a match get nulls. The columns of `left` must not be called _t, _o, _tag, _b."""
    payload = F.struct(*[F.col(r).alias(n) for n, r in take.items()])
    sign = -1 if forward else 1
    tag_right, tag_left = (0, 1) if equal else (1, 0)
    own = left.columns
    lefts = left.select(F.struct("*").alias("_l"), *by, (left_time * sign).alias("_t"), F.lit(tag_left).alias("_tag"))
    rights = right.select(*by, (right_time * sign).alias("_t"), F.struct(*[(F.col(c) * sign).alias(c) for c in right_order]).alias("_o"), payload.alias("_r"), F.lit(tag_right).alias("_tag"))
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    within = Window.partitionBy(*by, "_b").orderBy("_t", "_tag", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last("_r", ignorenulls=True).over(within)).where("_l is not null")
    tops = rows.groupBy(*by, "_b").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_o", "_r"))).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_b", F.last("_top", ignorenulls=True).over(before)["_r"].alias("_far"))
    joined = near.join(carried, [*by, "_b"], "left").withColumn("_found", F.coalesce("_near", "_far"))
    return joined.select(*[F.col("_l")[c].alias(c) for c in own], *[F.col("_found")[n].alias(n) for n in take])


@dataclass(frozen=True)
class Lookup:
    """One of several lookups: the last right row up to `time`, or (forward) the first from it on; equal: `time` included."""

    name: str
    time: Column
    forward: bool = False
    equal: bool = True


def asof_many(left: DataFrame, right: DataFrame, by: list[str], key: list[str], lookups: list[Lookup], right_time: Column, right_order: list[str], take: list[str], width: int) -> DataFrame:
    """Several as-of lookups of the same right side in one pass: adds, for each lookup, its columns `take` as a struct of its
    name (null without a match). `key` makes the rows of `left` unique. Every left row is tagged once for each lookup; one
    exchange sorts all of them with the right side, a second one brings the answers of a row together."""
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), x.time.cast("long").alias("_t"), F.lit(1 if x.equal != x.forward else -1).alias("_tag")) for i, x in enumerate(lookups)]))
    lefts = left.select(F.struct("*").alias("_l"), *by, asked.alias("_a")).select("_l", *by, "_a.*")
    payload = F.struct(*take)
    rights = right.select(*by, right_time.alias("_t"), F.struct(*right_order).alias("_o"), payload.alias("_r"), F.lit(0).alias("_tag"))
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    forward = [i for i, x in enumerate(lookups) if x.forward]
    at = Window.partitionBy(*by, "_b")
    up = at.orderBy("_t", "_tag", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = at.orderBy(F.desc("_t"), F.desc("_tag"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last("_r", ignorenulls=True)
    found = rows.withColumn("_near", F.when(F.col("_k").isin(forward), near.over(down)).otherwise(near.over(up)) if forward else near.over(up)).where("_l is not null")
    own = F.when(F.col("_r").isNotNull(), F.struct("_t", "_o", "_r"))
    tops = rows.where("_r is not null").groupBy(*by, "_b").agg(F.max(own).alias("_top"), F.min(own).alias("_low"))
    # buckets without a right row need one, too: they get what was carried past them
    asked_for = rows.where("_l is not null").select(*by, "_b").distinct()
    tops = asked_for.join(tops, [*by, "_b"], "full")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_b", F.last("_top", ignorenulls=True).over(before)["_r"].alias("_past"), *([F.last("_low", ignorenulls=True).over(after)["_r"].alias("_next")] if forward else []))
    joined = found.join(carried, [*by, "_b"], "left")
    far = F.when(F.col("_k").isin(forward), F.col("_next")).otherwise(F.col("_past")) if forward else F.col("_past")
    answers = joined.select(F.col("_l"), "_k", F.coalesce("_near", far).alias("_found"))
    together = answers.groupBy(*[F.col("_l")[c].alias(f"_key_{c}") for c in key]).agg(F.first("_l").alias("_l"), *[F.first(F.when(F.col("_k") == i, F.col("_found")), ignorenulls=True).alias(f"_f{i}") for i in range(len(lookups))])
    return together.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col(f"_f{i}").alias(x.name) for i, x in enumerate(lookups)])
