"""Order-book pressure, iceberg refills, volume clocks, informed-trading flows, self-excitation, heatmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import price_bucket, ratio, rows_back, span_back, up_to_now
from tidemark.operators.blocks import blocked, blocked_sum
from tidemark.plans.trading import SQL as TRADING_SQL
from tidemark.plans.trading import tqr_anomaly
from tidemark.sources.adapters import DAILY_SQL, HOUR, MINUTE, TICKS_SQL, books, daily_trades, orders, quotes, trades

# -- order books ------------------------------------------------------------------------------------------------------

DEPTH, PRESSURE_DECAY, PRESSURE_TERMS, FLOW_WINDOW = 5, 0.95, 90, 1000 * MINUTE


def _volume(side: str, k: int = DEPTH) -> Column:
    return F.aggregate(F.slice(side, 1, k), F.lit(0).cast("long"), lambda a, x: a + x["quantity"])


def _weighted(side: str, k: int = DEPTH) -> Column:
    """Quantities, each over its level's number."""
    return F.aggregate(F.transform(F.slice(side, 1, k), lambda x, i: x["quantity"] / (i + 1).cast("double")), F.lit(0.0), lambda a, x: a + x)


def _imbalance(bid: Column, ask: Column) -> Column:
    return F.coalesce(ratio(bid - ask, bid + ask), F.lit(0.0))


def book_levels(b: DataFrame) -> DataFrame:
    """Imbalances of the first level, by depth and weighted by level; visible volume; prices inside the spread."""
    bid, ask = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    bq, aq, bp, ap = bid["quantity"], ask["quantity"], bid["price_e4"], ask["price_e4"]
    micro = lambda s: F.aggregate(F.slice(s, 1, DEPTH), F.lit(0).cast("long"), lambda a, x: a + x["price_e4"] * x["quantity"])
    return b.select(
        "symbol", "quote_seq", "ts_ns", _imbalance(bq, aq).alias("l1"), _imbalance(_volume("bids"), _volume("asks")).alias("depth"), _imbalance(_weighted("bids"), _weighted("asks")).alias("weighted"),
        (_volume("bids") + _volume("asks")).alias("visible"), (ap - bp).alias("spread_e4"), ratio((ap - bp) * 10000, F.expr("(bids[0].price_e4 + asks[0].price_e4) div 2")).alias("spread_bps"),
        ratio(bp * aq + ap * bq, bq + aq).alias("weighted_mid"), ratio(micro("bids") + micro("asks"), _volume("bids") + _volume("asks")).alias("micro_price"),
    )


def book_pressure(b: DataFrame) -> DataFrame:
    """Weighted imbalances of the window, newest first, fading by 0.95 each; build-up: the last five strong pressures
    exceed the average of those before by half."""
    rows = book_levels(b).select("symbol", "quote_seq", "ts_ns", "visible", F.round("weighted", 9).alias("weighted"))
    rows = rows.withColumn("_h", F.reverse(F.collect_list(F.struct("ts_ns", "weighted")).over(rows_back(PRESSURE_TERMS, "symbol", order=("ts_ns", "quote_seq")))))
    recent_ones = F.filter("_h", lambda x: x["ts_ns"] >= F.col("ts_ns") - FLOW_WINDOW)
    total = F.aggregate(F.transform(recent_ones, lambda x, i: x["weighted"] * F.pow(F.lit(PRESSURE_DECAY), i.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("signed", F.round(total, 6)).withColumn("pressure", F.abs("signed"))
    strong = rows.where("pressure > 0.5")
    recent, older = rows_back(5, "symbol", order=("ts_ns", "quote_seq")), Window.partitionBy("symbol").orderBy("ts_ns", "quote_seq").rowsBetween(-999, -5)
    count = F.count("*").over(rows_back(1000, "symbol", order=("ts_ns", "quote_seq")))
    built = (count >= 5) & (F.avg("pressure").over(recent) > F.coalesce(F.avg("pressure").over(older), F.lit(0.0)) * 1.5)
    marks = strong.select("symbol", "quote_seq", built.alias("buildup"))
    out = rows.drop("_h").join(marks, ["symbol", "quote_seq"], "left").withColumn("buildup", F.coalesce("buildup", F.lit(False)))
    return out.select("symbol", "quote_seq", "ts_ns", "visible", "weighted", "pressure", F.when(F.col("signed") > 0, "BUY").otherwise("SELL").alias("pressure_side"), "buildup")


def flow_tumbling(t: DataFrame, width: int = FLOW_WINDOW) -> DataFrame:
    """Bought, sold and hidden volume of tumbling windows; every side but BUY counts as sold."""
    buy = F.col("side") == "BUY"
    return t.groupBy("symbol", F.expr(f"ts_ns div {width}").alias("w")).agg(
        F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("bought"), F.sum(F.when(buy, 0).otherwise(F.col("quantity"))).alias("sold"), F.sum(F.when(F.col("is_hidden"), F.col("quantity")).otherwise(0)).alias("hidden")
    )


def flow_anchored(t: DataFrame, width: int = FLOW_WINDOW) -> DataFrame:
    """The same in windows that begin with a trade: a new one starts at the first trade later than the last start plus the
    width. Where one starts depends on where the last one did, so each symbol is walked in order."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_ns", "trade_seq"])
        starts, start = [], None
        for ts in rows.ts_ns.tolist():
            if start is None or ts - start > width:
                start = ts
            starts.append(start)
        rows = rows.assign(window_start=starts, bought=rows.quantity.where(rows.side == "BUY", 0), sold=rows.quantity.where(rows.side != "BUY", 0), hidden=rows.quantity.where(rows.is_hidden, 0))
        sums = rows.groupby("window_start")[["bought", "sold", "hidden"]].cumsum()
        return rows[["symbol", "trade_seq", "ts_ns", "window_start"]].assign(bought=sums.bought, sold=sums.sold, hidden=sums.hidden)

    return t.select("symbol", "trade_seq", "ts_ns", "side", "quantity", "is_hidden").groupBy("symbol").applyInPandas(walk, "symbol long, trade_seq long, ts_ns long, window_start long, bought long, sold long, hidden long")


def flow_ratio(b: DataFrame, t: DataFrame) -> DataFrame:
    """Flow of the window that ends with the book over its visible volume, raised by the hidden share; 1 without visible
    volume."""
    buy = F.col("side") == "BUY"
    rows = book_levels(b).select("symbol", "quote_seq", "ts_ns", "visible")
    rows = rows.unionByName(t.select("symbol", "ts_ns", F.when(buy, F.col("quantity")).otherwise(0).alias("b"), F.when(buy, 0).otherwise(F.col("quantity")).alias("s"), F.when(F.col("is_hidden"), F.col("quantity")).otherwise(0).alias("h")), allowMissingColumns=True)
    rows, _, _ = blocked(rows, ["symbol"], "ts_ns", FLOW_WINDOW)
    total = lambda c: blocked_sum(F.col(c), ["symbol"], "ts_ns", FLOW_WINDOW)
    rows = rows.select("symbol", "quote_seq", "visible", "_own", *[F.coalesce(total(c), F.lit(0)).alias(n) for c, n in (("b", "bought"), ("s", "sold"), ("h", "hidden"))]).where("_own and quote_seq is not null")
    flow = F.col("bought") + F.col("sold")
    value = F.coalesce(ratio(flow, F.col("visible")) * (1 + F.coalesce(ratio(F.col("hidden"), flow), F.lit(0.0))), F.lit(1.0))
    return rows.select("symbol", "quote_seq", F.round(value, 6).alias("hidden_ratio"))


def book_anomaly(b: DataFrame, t: DataFrame) -> DataFrame:
    rows = book_pressure(b).join(flow_ratio(b, t), ["symbol", "quote_seq"])
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns", "quote_seq"))
    hidden = F.col("hidden_ratio") > 2
    rows = rows.withColumn("n", n).where((F.col("n") >= 10) & (F.abs("weighted") > 0.7) & (hidden | F.col("buildup")))
    confidence = F.round(0.3 + F.when(hidden, 0.4).otherwise(0.0) + F.when(F.col("buildup"), 0.3).otherwise(0.0), 6)
    return rows.select("symbol", "quote_seq", confidence.alias("confidence"), F.col("pressure").alias("magnitude"), F.round(F.abs("weighted") * F.col("hidden_ratio") * 10000, 2).alias("hidden"))


def book_flags(b: DataFrame) -> DataFrame:
    """Volumes out of balance (over 2 or under 1/2), little at the top (ten times as much below), and rapid flips: the
    weighted imbalance changes its sign from one book to the next and is strong both times."""
    bid, ask = _volume("bids"), _volume("asks")
    top = F.get("bids", F.lit(0))["quantity"] + F.get("asks", F.lit(0))["quantity"]
    rows = b.select("symbol", "quote_seq", "ts_ns", ratio(bid, ask).alias("r"), ratio(bid + ask - top, top).alias("d"), F.round(_imbalance(_weighted("bids"), _weighted("asks")), 9).alias("w"))
    before = F.lag("w").over(Window.partitionBy("symbol").orderBy("ts_ns", "quote_seq"))
    flip = F.coalesce((F.col("w") * before < 0) & (F.abs("w") > 0.3) & (F.abs(before) > 0.3), F.lit(False))
    return rows.select("symbol", "quote_seq", ((F.col("r") > 2) | (F.col("r") < 0.5)).alias("unbalanced"), (F.col("d") > 10).alias("thin_top"), flip.alias("flip"))


_BOOKS_SQL = f"""{TICKS_SQL},
lv AS (SELECT symbol, quote_seq, ts_ns, i, bid_e4 - 100 * i AS bp, greatest(100, bid_size + 100 * i) AS bq, ask_e4 + 100 * i AS ap, greatest(100, ask_size - 100 * i) AS aq
  FROM (SELECT *, unnest(range(0, {DEPTH})) AS i FROM quotes)),
bk AS (SELECT symbol, quote_seq, ts_ns, sum(bq)::BIGINT AS b, sum(aq)::BIGINT AS a, sum(bq::DOUBLE / (i + 1)) AS wb, sum(aq::DOUBLE / (i + 1)) AS wa, sum(bp * bq + ap * aq)::BIGINT AS pq,
  any_value(bp) FILTER (i = 0) AS b0, any_value(ap) FILTER (i = 0) AS a0, any_value(bq) FILTER (i = 0) AS bq0, any_value(aq) FILTER (i = 0) AS aq0 FROM lv GROUP BY ALL)"""

_PRESSURE_SQL = f"""{_BOOKS_SQL},
wi AS (SELECT symbol, quote_seq, ts_ns, b + a AS visible, round((wb - wa) / (wb + wa), 9) AS weighted FROM bk),
po AS (SELECT x.symbol, x.quote_seq, o.weighted AS v, row_number() OVER (PARTITION BY x.symbol, x.quote_seq ORDER BY o.ts_ns DESC, o.quote_seq DESC) AS k
  FROM wi x JOIN wi o ON o.symbol = x.symbol AND o.ts_ns BETWEEN x.ts_ns - {FLOW_WINDOW} AND x.ts_ns),
ps AS (SELECT symbol, quote_seq, round(sum(v * pow({PRESSURE_DECAY}::DOUBLE, k - 1)), 6) AS sg FROM po WHERE k <= {PRESSURE_TERMS} GROUP BY ALL),
st AS (SELECT symbol, quote_seq, ts_ns, abs(sg) AS p FROM ps JOIN wi USING (symbol, quote_seq) WHERE abs(sg) > 0.5),
bu AS (SELECT symbol, quote_seq, count(*) OVER (o ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) >= 5 AND avg(p) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > coalesce(avg(p) OVER (o ROWS BETWEEN 999 PRECEDING AND 5 PRECEDING), 0) * 1.5::DOUBLE AS buildup
  FROM st WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, quote_seq)),
pr AS (SELECT symbol, quote_seq, ts_ns, visible, weighted, abs(sg) AS pressure, CASE WHEN sg > 0 THEN 'BUY' ELSE 'SELL' END AS pressure_side, coalesce(buildup, false) AS buildup
  FROM wi JOIN ps USING (symbol, quote_seq) LEFT JOIN bu USING (symbol, quote_seq)),
fl AS (SELECT symbol, ts_ns // {FLOW_WINDOW} AS w, coalesce(sum(quantity) FILTER (side = 'BUY'), 0)::BIGINT AS bought, coalesce(sum(quantity) FILTER (side <> 'BUY'), 0)::BIGINT AS sold, coalesce(sum(quantity) FILTER (is_hidden), 0)::BIGINT AS hidden FROM trades GROUP BY ALL),
fo AS (SELECT x.symbol, x.quote_seq, any_value(visible) AS visible, coalesce(sum(quantity), 0) AS flow, coalesce(sum(quantity) FILTER (is_hidden), 0) AS hidden FROM wi x LEFT JOIN trades t ON t.symbol = x.symbol AND t.ts_ns BETWEEN x.ts_ns - {FLOW_WINDOW} AND x.ts_ns GROUP BY ALL),
fr AS (SELECT symbol, quote_seq, round(coalesce(flow / nullif(visible, 0) * (1 + coalesce(hidden / nullif(flow, 0), 0)), 1), 6) AS hidden_ratio FROM fo)"""


# -- iceberg refills --------------------------------------------------------------------------------------------------

#: For the registered queries prices are rounded to PRICE_STEP, since ticks here seldom meet a price twice, sizes may vary
#: by LOOSE, and the other gates are wider than the functions' defaults.
SILENCE, REFILL_WINDOW, REFILLS, PRICE_STEP, LOOSE = 3000 * MINUTE, 6000 * MINUTE, 3, 500_000, 0.35
VPIN_SIGMAS, VPIN_TOXIC, HAWKES_TIMES = 0.25, 0.18, 75.0


def refills(o: DataFrame, price_step: int = 1, consistent: float = 0.2) -> DataFrame:
    """Orders by price level and session (a level is forgotten after a silence), with the pattern's tests: enough orders in
    the window, and the last three sizes within `consistent` of their mean."""
    level = o.select("symbol", "side", F.expr(f"price_e4 div {price_step}").alias("level"), "order_id", "ts_ns", "quantity")
    w = Window.partitionBy("symbol", "side", "level").orderBy("ts_ns", "order_id")
    fresh = F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(w) > SILENCE, F.lit(True)).cast("int")
    level = level.withColumn("session", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = ("symbol", "side", "level", "session")
    ever, last = up_to_now(*by, order=("ts_ns", "order_id")), rows_back(REFILLS, *by, order=("ts_ns", "order_id"))
    rows = level.select(
        *by, "order_id", "ts_ns", "quantity", F.count("*").over(span_back(REFILL_WINDOW, *by)).alias("recent"), F.count("*").over(ever).alias("refill_count"), F.first("ts_ns").over(ever).alias("first_seen"),
        F.avg("quantity").over(last).alias("m3"), F.max("quantity").over(last).alias("hi"), F.min("quantity").over(last).alias("lo"), F.sum(F.col("quantity").cast("double")).over(ever).alias("s"), F.sum(F.col("quantity").cast("double") * F.col("quantity")).over(ever).alias("s2"),
    )
    even = F.greatest(F.col("hi") - F.col("m3"), F.col("m3") - F.col("lo")) <= consistent * F.col("m3")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("refill_count") - (F.col("s") / F.col("refill_count")) * (F.col("s") / F.col("refill_count"))))
    return rows.where((F.col("recent") >= REFILLS) & even).withColumn("confidence", F.round(1 - F.least(F.lit(1.0), spread / F.col("quantity")), 6)).select(*by, "order_id", "ts_ns", "first_seen", F.col("quantity").alias("visible"), "refill_count", "confidence")


def executed(t: DataFrame, price_step: int = 1) -> DataFrame:
    """Traded quantity of price levels; buyers take from the sell side's."""
    side = F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")
    return t.groupBy("symbol", side.alias("side"), F.expr(f"price_e4 div {price_step}").alias("level")).agg(F.sum("quantity").alias("executed"))


def icebergs(o: DataFrame, t: DataFrame, price_step: int = 1, consistent: float = 0.2) -> DataFrame:
    """The latest pattern of each level, with executed and estimated totals (five visible sizes on top)."""
    latest = Window.partitionBy("symbol", "side", "level").orderBy(F.desc("ts_ns"), F.desc("order_id"))
    rows = refills(o, price_step, consistent).withColumn("k", F.row_number().over(latest)).where("k = 1").join(executed(t, price_step), ["symbol", "side", "level"], "left")
    done = F.coalesce("executed", F.lit(0))
    return rows.select("symbol", "side", "level", "order_id", "ts_ns", "visible", "refill_count", "confidence", done.alias("executed"), (done + 5 * F.col("visible")).alias("estimated"))


def iceberg_best(o: DataFrame, t: DataFrame, price_step: int = 1, consistent: float = 0.2) -> DataFrame:
    """The iceberg with the largest confidence times total of each symbol, if over 0.7."""
    score = F.struct((F.col("confidence") * F.col("estimated")).alias("score"), (-F.col("level")).alias("level"), "side")
    best = icebergs(o, t, price_step, consistent).groupBy("symbol").agg(F.max_by(F.struct("side", "level", "ts_ns", "visible", "executed", "estimated", "confidence"), score).alias("b")).select("symbol", "b.*").where("confidence > 0.7")
    return best.select("symbol", "side", "level", "ts_ns", "confidence", F.round(ratio(F.col("estimated"), F.col("visible")), 6).alias("magnitude"), (F.col("estimated") - F.col("executed")).alias("hidden"))


_REFILL_SQL = f"""{TICKS_SQL},
l0 AS (SELECT symbol, side, price_e4 // 500000 AS level, order_id, ts_ns, quantity, CASE WHEN coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY symbol, side, price_e4 // 500000 ORDER BY ts_ns, order_id) > {SILENCE}, true) THEN 1 ELSE 0 END AS fresh FROM orders_in),
l1 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, side, level ORDER BY ts_ns, order_id)::BIGINT AS session FROM l0),
l2 AS (SELECT *, count(*) OVER (PARTITION BY symbol, side, level, session ORDER BY ts_ns RANGE BETWEEN {REFILL_WINDOW} PRECEDING AND CURRENT ROW) AS recent, count(*) OVER e AS refill_count, first_value(ts_ns) OVER e AS first_seen,
  avg(quantity) OVER r AS m3, max(quantity) OVER r AS hi, min(quantity) OVER r AS lo, sum(quantity::DOUBLE) OVER e AS s, sum(quantity::DOUBLE * quantity) OVER e AS s2 FROM l1
  WINDOW e AS (PARTITION BY symbol, side, level, session ORDER BY ts_ns, order_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY symbol, side, level, session ORDER BY ts_ns, order_id ROWS BETWEEN {REFILLS - 1} PRECEDING AND CURRENT ROW)),
rf AS (SELECT symbol, side, level, session, order_id, ts_ns, first_seen, quantity AS visible, refill_count, round(1 - least(1.0::DOUBLE, sqrt(greatest(0, s2 / refill_count - (s / refill_count) * (s / refill_count))) / quantity), 6) AS confidence
  FROM l2 WHERE recent >= {REFILLS} AND greatest(hi - m3, m3 - lo) <= {LOOSE}::DOUBLE * m3),
ex AS (SELECT symbol, CASE WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS side, price_e4 // 500000 AS level, sum(quantity)::BIGINT AS executed FROM trades GROUP BY ALL),
ic AS (SELECT symbol, side, level, order_id, ts_ns, visible, refill_count, confidence, coalesce(executed, 0) AS executed, coalesce(executed, 0) + 5 * visible AS estimated
  FROM (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY symbol, side, level ORDER BY ts_ns DESC, order_id DESC) = 1) LEFT JOIN ex USING (symbol, side, level))"""


# -- volume clock -----------------------------------------------------------------------------------------------------

BUCKET, VPIN_BUCKETS, VPIN_LEAST, TOXIC = 50_000, 50, 10, 0.3
DAY_ORDER = ("day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def vpin_equal(t: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Buckets of equal volume: a trade belongs where the volume up to and with it ends. Unknown sides count half and half."""
    run = F.sum("quantity").over(up_to_now("symbol", order=DAY_ORDER))
    rows = t.withColumn("bucket", ((run - 1) / bucket).cast("long"))
    half = F.when(F.col("side") == "UNKNOWN", F.col("quantity") / 2).otherwise(0.0)
    vol = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity").cast("double")).otherwise(half))
    first = F.struct(*DAY_ORDER)
    sums = rows.groupBy("symbol", "bucket").agg(F.sum("quantity").alias("volume"), vol("BUY").alias("buy"), vol("SELL").alias("sell"), F.count("*").alias("trades"), F.min_by("price_e4", first).alias("open"), F.max_by("price_e4", first).alias("close"), F.sum(F.col("price_e4") * F.col("quantity")).alias("pq"), F.max("day").alias("last_day"))
    return sums.select("symbol", "bucket", "volume", "buy", "sell", "trades", "open", "close", F.round(F.col("pq") / F.col("volume"), 4).alias("vwap"), F.round(F.abs(F.col("buy") - F.col("sell")) / F.col("volume"), 6).alias("imbalance"), "last_day")


def vpin_rolling(t: DataFrame, bucket: int = BUCKET, buckets: int = VPIN_BUCKETS, toxic: float = TOXIC) -> DataFrame:
    """Mean imbalance of the last fifty buckets, its z-score against all so far, and the toxicity gate."""
    w, ever = rows_back(buckets, "symbol", order=("bucket",)), up_to_now("symbol", order=("bucket",))
    i = F.col("i")
    exact = (F.abs(F.col("buy") - F.col("sell")) / F.col("volume")).alias("i")
    rows = vpin_equal(t, bucket).select("symbol", "bucket", exact).select("symbol", "bucket", F.avg(i).over(w).alias("vpin"), F.count("*").over(w).alias("n"), F.avg(i).over(ever).alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.avg(i * i).over(ever) - F.avg(i).over(ever) * F.avg(i).over(ever))).alias("sd")).where(f"n >= {VPIN_LEAST}")
    z = F.round(ratio(F.col("vpin") - F.col("m"), F.round("sd", 9)), 4)
    return rows.select("symbol", "bucket", F.round("vpin", 6).alias("vpin"), z.alias("z"), (F.round("vpin", 6) > toxic).alias("toxic"))


def vpin_anomaly(t: DataFrame, sigmas: float = 2.0, bucket: int = BUCKET, buckets: int = VPIN_BUCKETS, toxic: float = TOXIC) -> DataFrame:
    """Toxic buckets whose mean imbalance is more than `sigmas` standard deviations over that of all so far."""
    last = vpin_equal(t, bucket).select("symbol", "bucket", "imbalance", "last_day")
    rows = vpin_rolling(t, bucket, buckets, toxic).join(last, ["symbol", "bucket"]).where(F.col("toxic") & (F.col("z") > sigmas))
    return rows.select("symbol", "bucket", "last_day", F.round(F.least(F.lit(1.0), F.col("z") / 4), 6).alias("confidence"), F.round(F.col("vpin") / toxic, 5).alias("magnitude"), F.round(F.col("imbalance") * bucket * 10, 1).alias("hidden"))


def support_levels(low: int, high: int, share: float = 0.01) -> np.ndarray:
    """From the lowest to the highest price in steps of a hundredth of the range; one level if that is no step."""
    step = int((high - low) * share)
    return np.array([low]) if step == 0 else np.arange(low, high + 1, step)


def bulk_classified(prices: np.ndarray, volumes: np.ndarray) -> tuple[float, float]:
    """Bought and sold volume by level: above the level of the volume's median, or not; above the last level: neither."""
    levels = support_levels(int(prices.min()), int(prices.max()))
    at = np.searchsorted(levels, prices, side="left")
    inside = at < len(levels)
    by_level = np.bincount(at[inside], weights=volumes[inside], minlength=len(levels))
    middle = int(np.argmax(np.cumsum(by_level) >= by_level.sum() * 0.5))
    up = inside & (at > middle)
    return float(volumes[up].sum()), float(volumes[inside & ~up].sum())


def vpin_exact(t: DataFrame, bucket: int = BUCKET, days: int = 60) -> DataFrame:
    """Buckets that close when they hold enough volume or time: the overshoot stays in the bucket, so the next one starts
    anew and each symbol is walked in order. Volumes are classified in bulk."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(DAY_ORDER))
        quantity, day = rows.quantity.to_numpy(), pd.to_datetime(rows.day).to_numpy().astype("datetime64[D]").astype(np.int64)
        number, total, start, ids = 0, 0, None, np.empty(len(rows), np.int64)
        for k, (q, d) in enumerate(zip(quantity.tolist(), day.tolist(), strict=True)):
            start = d if start is None else start
            ids[k] = number
            total += q
            if total >= bucket or d - start > days:
                number, total, start = number + 1, 0, None
        out = []
        last = number - 1 if start is None else number
        for b, g in rows.assign(b=ids).groupby("b"):
            v = g.quantity.to_numpy()
            buy, sell = bulk_classified(g.price_e4.to_numpy(), v)
            out.append((g.symbol.iloc[0], b, int(v.sum()), len(g), buy, sell, abs(buy - sell) / v.sum(), b < last or start is None))
        return pd.DataFrame(out, columns=["symbol", "bucket", "volume", "trades", "buy", "sell", "imbalance", "complete"])

    return t.select("symbol", "price_e4", "quantity", *DAY_ORDER).groupBy("symbol").applyInPandas(walk, "symbol long, bucket long, volume long, trades long, buy double, sell double, imbalance double, complete boolean")


_VPIN_SQL = f"""{DAILY_SQL},
vb AS (SELECT *, (sum(quantity) OVER (PARTITION BY symbol ORDER BY {', '.join(DAY_ORDER)} ROWS UNBOUNDED PRECEDING) - 1) // {BUCKET} AS bucket FROM daily),
ve AS (SELECT symbol, bucket::BIGINT AS bucket, sum(quantity)::BIGINT AS volume, sum(CASE side WHEN 'BUY' THEN quantity::DOUBLE WHEN 'UNKNOWN' THEN quantity / 2 ELSE 0 END) AS buy, sum(CASE side WHEN 'SELL' THEN quantity::DOUBLE WHEN 'UNKNOWN' THEN quantity / 2 ELSE 0 END) AS sell,
  count(*) AS trades, arg_min(price_e4, ({', '.join(DAY_ORDER)})) AS open, arg_max(price_e4, ({', '.join(DAY_ORDER)})) AS close, sum(price_e4 * quantity)::DOUBLE AS pq, max(day) AS last_day FROM vb GROUP BY ALL),
vi AS (SELECT symbol, bucket, volume, buy, sell, trades, open, close, round(pq / volume, 4) AS vwap, round(abs(buy - sell) / volume, 6) AS imbalance, last_day FROM ve),
vm AS (SELECT symbol, bucket, avg(i) OVER w AS vpin, count(*) OVER w AS n, avg(i) OVER e AS m, sqrt(greatest(0, avg(i * i) OVER e - avg(i) OVER e * avg(i) OVER e)) AS sd FROM (SELECT symbol, bucket, abs(buy - sell) / volume AS i FROM ve)
  WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {VPIN_BUCKETS - 1} PRECEDING AND CURRENT ROW), e AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
vr AS (SELECT symbol, bucket, round(vpin, 6) AS vpin, round((vpin - m) / nullif(round(sd, 9), 0), 4) AS z, round(vpin, 6) > {TOXIC} AS toxic FROM vm WHERE n >= {VPIN_LEAST})"""


# -- informed trading -------------------------------------------------------------------------------------------------

PIN_START = (0.2, 0.5, 100.0, 50.0, 50.0)  # alpha, delta, mu, epsilon buy, epsilon sell
PIN_STEPS, PIN_TOLERANCE, PIN_LEAST_DAYS, PIN_KEPT = 100, 1e-6, 5, 60


#: Least trades and period of the registered queries: lineitem has few trades a day.
PERIODS = {"least": 20, "period": "month"}


def daily_flow(t: DataFrame, least: int = 100, period: str = "day") -> DataFrame:
    """Bought and sold counts and volumes of each period with enough trades, the last sixty of them."""
    n = lambda s: F.count_if(F.col("side") == s)
    v = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("quantity"))), F.lit(0))
    days = t.groupBy("symbol", (F.col("day") if period == "day" else F.trunc("day", period)).alias("period")).agg(n("BUY").alias("buys"), n("SELL").alias("sells"), v("BUY").alias("buy_volume"), v("SELL").alias("sell_volume"), F.count("*").alias("trades")).where(F.col("trades") >= least)
    late = Window.partitionBy("symbol").orderBy(F.desc("period"))
    return days.withColumn("age", F.row_number().over(late)).where(F.col("age") <= PIN_KEPT).drop("age")


def intraday_pin(t: DataFrame) -> DataFrame:
    """Half the imbalance of bought and sold trades by hour of the day, over ten trades; the mean over all 24 hours."""
    hours = t.groupBy("symbol", F.expr(f"ts_ns div {HOUR} % 24").alias("hour")).agg(F.count_if(F.col("side") == "BUY").alias("b"), F.count_if(F.col("side") == "SELL").alias("s"))
    value = F.when(F.col("b") + F.col("s") > 10, 0.5 * F.abs(F.col("b") - F.col("s")) / (F.col("b") + F.col("s"))).otherwise(0.0)
    mean = F.sum("pin").over(Window.partitionBy("symbol")) / 24
    rows = hours.withColumn("pin", value).select("symbol", "hour", "b", "s", F.round("pin", 6).alias("pin"), F.round(mean, 6).alias("daily_average"))
    return rows.withColumn("spike", (F.col("pin") > 2 * F.col("daily_average")) & (F.col("pin") > 0.2))


def intraday_spikes(t: DataFrame) -> DataFrame:
    """Hours of the day whose proxy is over 0.2 and twice the average, with the last trade in them."""
    last = t.groupBy("symbol", F.expr(f"ts_ns div {HOUR} % 24").alias("hour")).agg(F.max("ts_ns").alias("ts_ns"))
    rows = intraday_pin(t).where("spike").join(last, ["symbol", "hour"])
    return rows.select("symbol", "hour", "ts_ns", F.lit(0.7).alias("confidence"), F.round(F.col("pin") / F.col("daily_average"), 4).alias("magnitude"))


def _log_poisson(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """log of the Poisson mass, up to the k! that all scenarios of a day share."""
    return k * np.log(rate) - rate


def fit_pin(buys: np.ndarray, sells: np.ndarray, start: tuple = PIN_START, steps: int = PIN_STEPS) -> dict:
    """Expectation maximisation over days without news, with good and with bad news; likelihoods stay in logs."""
    alpha, delta, mu, eb, es = start
    last, n = -np.inf, len(buys)
    for _ in range(steps):
        logs = np.stack([
            np.log(1 - alpha) + _log_poisson(buys, eb) + _log_poisson(sells, es),
            np.log(alpha * (1 - delta)) + _log_poisson(buys, eb + mu) + _log_poisson(sells, es),
            np.log(alpha * delta) + _log_poisson(buys, eb) + _log_poisson(sells, es + mu),
        ])
        top = logs.max(axis=0)
        whole = top + np.log(np.exp(logs - top).sum(axis=0))
        if abs(whole.sum() - last) < PIN_TOLERANCE:
            break
        last = whole.sum()
        none, good, bad = np.exp(logs - whole)
        g, b = good.sum(), bad.sum()
        alpha = (g + b) / n
        delta = b / (g + b) if g + b > 0 else delta
        if g > 0:
            mu = (good * buys).sum() / g
        if b > 0:
            mu = (mu + (bad * sells).sum() / b) / 2
        eb, es = ((none + bad) * buys).sum() / n, ((none + good) * sells).sum() / n
        alpha, delta = np.clip((alpha, delta), 0.01, 0.99)
        mu, eb, es = max(1.0, mu), max(1.0, eb), max(1.0, es)
    return {"alpha": float(alpha), "delta": float(delta), "mu": float(mu), "epsilon_b": float(eb), "epsilon_s": float(es), "pin": float(alpha * mu / (alpha * mu + eb + es))}


_PIN_SCHEMA = "alpha double, delta double, mu double, epsilon_b double, epsilon_s double, pin double"


def pin_em(t: DataFrame, least: int = 100, period: str = "day") -> DataFrame:
    """The fit of each symbol; groups are sixty rows at most. The gate: over 0.25."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("period")
        if len(g) < PIN_LEAST_DAYS:
            return pd.DataFrame(columns=["symbol", "days", "last", *x])
        return pd.DataFrame([{"symbol": g.symbol.iloc[0], "days": len(g), "last": g.period.iloc[-1], **fit_pin(g.buys.to_numpy(float), g.sells.to_numpy(float))}])

    x = [p.split()[0] for p in _PIN_SCHEMA.split(", ")]
    rows = daily_flow(t, least, period).groupBy("symbol").applyInPandas(fit, f"symbol long, days long, last date, {_PIN_SCHEMA}")
    return rows.withColumn("anomalous", F.col("pin") > 0.25).withColumn("confidence", F.least(F.lit(1.0), F.col("pin") / 0.4)).withColumn("hidden", F.col("alpha") * F.col("mu") * 100)


def pin_history(t: DataFrame, days: int = 10, least: int = 100, period: str = "day") -> DataFrame:
    """The fit of all periods up to each of the last ones."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("period").reset_index(drop=True)
        rows = [{"symbol": g.symbol.iloc[0], "period": g.period[k], "pin": fit_pin(g.buys[: k + 1].to_numpy(float), g.sells[: k + 1].to_numpy(float))["pin"]} for k in range(max(0, len(g) - days), len(g)) if k + 1 >= PIN_LEAST_DAYS]
        return pd.DataFrame(rows, columns=["symbol", "period", "pin"])

    return daily_flow(t, least, period).groupBy("symbol").applyInPandas(fit, "symbol long, period date, pin double")


# -- self-excitation --------------------------------------------------------------------------------------------------

MU, ALPHA, CROSS, BETA, HAWKES_KEPT = 0.5, 0.3, 0.1, 0.1, 1000
#: After so long an event has faded by exp(-40).
FADED = 400 * MINUTE


def _seconds(ns: Column) -> Column:
    """A minute of ticks counts as a second."""
    return ns.cast("double") / float(MINUTE)


def hawkes_events(t: DataFrame) -> DataFrame:
    return t.select("symbol", "trade_seq", "ts_ns", F.when(F.col("side") == "BUY", "BUY").otherwise("SELL").alias("side"), F.log1p(F.col("quantity") / 1000).alias("m"))


def hawkes_intensity(t: DataFrame) -> DataFrame:
    """Intensities just before each event from earlier ones. Each side's sum of decayed sizes is a sum of sizes that grow
    with the time since a block began, divided by the growth up to the event; what is older than FADED has left double
    precision (exp(-40)), so blocks of that length hold all that counts."""
    rows, _, age = blocked(hawkes_events(t), ["symbol"], "ts_ns", FADED, least=1)
    grown = F.col("m") * BETA * F.exp(BETA * age / float(MINUTE))
    past = lambda side: F.coalesce(blocked_sum(F.when(F.col("side") == side, grown), ["symbol"], "ts_ns", FADED, least=1), F.lit(0.0)) * F.exp(-BETA * age / float(MINUTE))
    rows = rows.select("symbol", "trade_seq", "_own", past("BUY").alias("b"), past("SELL").alias("s")).where("_own")
    buy, sell = MU + ALPHA * F.col("b") + CROSS * F.col("s"), MU + ALPHA * F.col("s") + CROSS * F.col("b")
    return rows.select("symbol", "trade_seq", F.round(buy, 5).alias("buy"), F.round(sell, 5).alias("sell"), F.round(buy / (buy + sell), 5).alias("buy_share"))


def hawkes_calibration(t: DataFrame) -> DataFrame:
    """Moments of the last thousand events: baseline, decay, excitation, branching ratio."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("trade_seq"))
    rows = hawkes_events(t).withColumn("k", F.row_number().over(w)).where(f"k <= {HAWKES_KEPT}")
    order = Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    rows = rows.withColumn("dt", _seconds(F.col("ts_ns") - F.lag("ts_ns").over(order))).withColumn("same", F.col("side") == F.lag("side").over(order))
    gap, close = (F.col("dt") > 0) & (F.col("dt") < 100), (F.col("dt") < 30) & (F.col("dt") > 0) & F.col("same")
    sums = rows.groupBy("symbol").agg(F.count("*").alias("n"), _seconds(F.max("ts_ns") - F.min("ts_ns")).alias("span"), F.avg(F.when(gap, F.col("dt"))).alias("gap"), F.avg(F.when(close, 1 / F.when(F.col("dt") > 0, F.col("dt")))).alias("burst")).where("n >= 50")
    base = F.col("n") / F.col("span")
    beta = F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.01), 1 / F.col("gap"))), F.lit(0.0))
    alpha = F.coalesce(F.least(F.lit(0.9), F.greatest(F.lit(0.0), F.col("burst") / base)), F.lit(0.0))
    out = sums.select("symbol", "n", F.round(base, 6).alias("baseline"), F.round(beta, 6).alias("beta"), F.round(alpha, 6).alias("alpha"))
    return out.withColumn("branching", F.round(F.least(F.lit(0.99), F.coalesce(ratio(F.col("alpha"), F.col("beta")), F.lit(0.0))), 5))


def hawkes_forecast(t: DataFrame, steps: int = 10, dt: float = 5.0) -> DataFrame:
    """From the intensity at the last event back to the baseline, with bounds of two square roots of the baseline."""
    last = t.groupBy("symbol").agg(F.max_by("trade_seq", F.struct("ts_ns", "trade_seq")).alias("trade_seq"))
    now = hawkes_intensity(t).join(last, ["symbol", "trade_seq"]).select("symbol", (F.col("buy") + F.col("sell")).alias("now"))
    rows = hawkes_calibration(t).join(now, "symbol").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    value = F.col("baseline") + (F.col("now") - F.col("baseline")) * F.exp(-F.col("beta") * F.col("step") * dt)
    half = 2 * F.sqrt("baseline")
    return rows.select("symbol", "step", F.round(value, 5).alias("expected"), F.round(F.greatest(F.lit(0.0), value - half), 5).alias("low"), F.round(value + half, 5).alias("high"))


def hawkes_grid(t: DataFrame, points: int = 100, step: int = 400 * MINUTE) -> DataFrame:
    """Total intensity on a regular grid that ends with the symbol's last event, from all earlier events that have not faded."""
    e = hawkes_events(t)
    ends = e.groupBy("symbol").agg(F.max("ts_ns").alias("end"))
    grid = ends.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "end").withColumn("at", F.col("end") - (points - 1 - F.col("point")) * F.lit(step))
    rows = grid.select("symbol", F.col("at").alias("ts_ns"), "point").unionByName(e.select("symbol", "ts_ns", "m"), allowMissingColumns=True)
    rows, _, age = blocked(rows, ["symbol"], "ts_ns", FADED, least=1)
    grown = F.coalesce(blocked_sum(F.col("m") * BETA * F.exp(BETA * age / float(MINUTE)), ["symbol"], "ts_ns", FADED, least=1), F.lit(0.0))
    rows = rows.select("symbol", "point", "_own", (grown * F.exp(-BETA * age / float(MINUTE))).alias("_sum")).where("_own and point is not null")
    sums = F.col("_sum")
    return rows.select("symbol", F.col("point").cast("long").alias("point"), F.round(2 * MU + (ALPHA + CROSS) * sums, 5).alias("total"))


def hawkes_ks(t: DataFrame) -> DataFrame:
    """Largest distance of the sorted residuals 1 - exp(-intensity dt) from the uniform law."""
    order = Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    e = hawkes_events(t).withColumn("dt", _seconds(F.col("ts_ns") - F.lag("ts_ns").over(order)))
    rows = e.join(hawkes_intensity(t), ["symbol", "trade_seq"]).where("dt is not null")
    rows = rows.withColumn("r", F.round(1 - F.exp(-F.when(F.col("side") == "BUY", F.col("buy")).otherwise(F.col("sell")) * F.col("dt")), 6))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("r", "trade_seq"))
    rows = rows.withColumn("i", rank).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    return rows.where("n >= 19").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("i") / F.col("n") - F.col("r"))), 5).alias("ks"))


def hawkes_anomaly(t: DataFrame, times: float = 3.0, least: int = 20) -> DataFrame:
    """Events at which the total intensity exceeds `times` the baseline: the calibrated one, or MU without one. Symbols of
    under `least` events have none."""
    n = t.groupBy("symbol").agg(F.count("*").alias("events")).where(F.col("events") >= least)
    model = n.join(hawkes_calibration(t), "symbol", "left").select("symbol", F.when(F.col("baseline") > 0, F.col("baseline")).otherwise(MU).alias("baseline"), F.coalesce("branching", F.lit(0.0)).alias("branching"))
    rows = hawkes_intensity(t).join(model, "symbol").withColumn("total", F.col("buy") + F.col("sell"))
    limit = times * F.col("baseline")
    direction = F.when(F.col("buy_share") > 0.6, "buy").when(F.col("buy_share") < 0.4, "sell").otherwise("mixed")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("total") / limit - 1) * (1 - F.col("branching"))))
    hidden = F.round((F.col("total") - F.col("baseline")) * 100_000, 1)
    return rows.where(F.col("total") > limit).select("symbol", "trade_seq", F.round(confidence, 4).alias("confidence"), F.round(F.col("total") / F.col("baseline"), 3).alias("magnitude"), hidden.alias("hidden"), direction.alias("direction"))


_HAWKES_SQL = f"""{TICKS_SQL},
he AS (SELECT symbol, trade_seq, ts_ns, CASE WHEN side = 'BUY' THEN 'BUY' ELSE 'SELL' END AS side, ln(1 + quantity / 1000) AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC, trade_seq DESC) AS k FROM trades),
hd AS (SELECT *, (ts_ns - lag(ts_ns) OVER o)::DOUBLE / {float(MINUTE)} AS dt, side = lag(side) OVER o AS same FROM he WHERE k <= {HAWKES_KEPT} WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq)),
hs AS (SELECT symbol, count(*) AS n, (max(ts_ns) - min(ts_ns))::DOUBLE / {float(MINUTE)} AS span, avg(dt) FILTER (dt > 0 AND dt < 100) AS gap, avg(1 / dt) FILTER (dt > 0 AND dt < 30 AND same) AS burst FROM hd GROUP BY symbol HAVING count(*) >= 50),
hc0 AS (SELECT symbol, n, round(n / span, 6) AS baseline, round(coalesce(least(10.0::DOUBLE, greatest(0.01::DOUBLE, 1 / gap)), 0), 6) AS beta, round(coalesce(least(0.9::DOUBLE, greatest(0.0::DOUBLE, burst / (n / span))), 0), 6) AS alpha FROM hs),
hc AS (SELECT *, round(least(0.99::DOUBLE, coalesce(alpha / nullif(beta, 0), 0)), 5) AS branching FROM hc0),
hx AS (SELECT a.symbol, a.trade_seq, coalesce(sum(b.m * {BETA}::DOUBLE * exp(-{BETA}::DOUBLE * (a.ts_ns - b.ts_ns) / {float(MINUTE)})) FILTER (b.side = 'BUY'), 0) AS xb,
  coalesce(sum(b.m * {BETA}::DOUBLE * exp(-{BETA}::DOUBLE * (a.ts_ns - b.ts_ns) / {float(MINUTE)})) FILTER (b.side = 'SELL'), 0) AS xs FROM he a LEFT JOIN he b ON a.symbol = b.symbol AND b.ts_ns < a.ts_ns AND b.ts_ns >= a.ts_ns - {4000 * MINUTE} GROUP BY ALL),
hi0 AS (SELECT symbol, trade_seq, {MU}::DOUBLE + {ALPHA}::DOUBLE * xb + {CROSS}::DOUBLE * xs AS b, {MU}::DOUBLE + {ALPHA}::DOUBLE * xs + {CROSS}::DOUBLE * xb AS s FROM hx),
hi AS (SELECT symbol, trade_seq, round(b, 5) AS buy, round(s, 5) AS sell, round(b / (b + s), 5) AS buy_share FROM hi0)"""


# -- heatmaps and activity --------------------------------------------------------------------------------------------


def heatmap_cells(t: DataFrame, decay: float = 0.95, rows: int = 60, width: int = 12 * HOUR) -> DataFrame:
    """Volumes by age and relative price, each shift of age fading by 0.95; the reference price is the first trade's."""
    first = t.groupBy("symbol").agg(F.min_by("price_e4", F.struct("ts_ns", "trade_seq")).alias("center"), F.max("ts_ns").alias("as_of"))
    age = F.floor((F.col("as_of") - F.col("ts_ns")) / width)
    cells = t.join(first, "symbol").withColumn("age", age).where(F.col("age") < rows).withColumn("cell", price_bucket(F.col("price_e4"), F.col("center"), width=0.01))
    fade = F.round(F.pow(F.lit(decay), F.col("age").cast("double")) * 1e9).cast("long")
    buy = F.col("side") == "BUY"
    vol = lambda c: F.coalesce(F.sum(F.when(c, F.col("quantity"))), F.lit(0))
    sums = cells.groupBy("symbol", "age", "cell").agg(vol(buy).alias("bought"), vol(~buy).alias("sold"), vol(F.col("is_hidden")).alias("hidden"), F.count("*").alias("trades"), F.first(fade).alias("fade"))
    # the fade in whole billionths: the product is then exact, and both sides of a comparison round it alike
    level = F.least(F.lit(1_000_000), F.expr("(bought + sold) * fade div 100000000"))
    return sums.select("symbol", F.col("age").cast("long").alias("age"), "cell", "bought", "sold", "hidden", "trades", (level / 1e6).alias("intensity"))


def heatmap_summary(t: DataFrame, last: int = 1000) -> DataFrame:
    """Center, totals, and the volume-weighted price of the last thousand trades."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("trade_seq")))
    rows = t.withColumn("k", k)
    sums = rows.groupBy("symbol").agg(F.min_by("price_e4", F.struct("ts_ns", "trade_seq")).alias("center"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"), F.sum(F.when(F.col("k") <= last, F.col("price_e4") * F.col("quantity"))).alias("pq"), F.sum(F.when(F.col("k") <= last, F.col("quantity"))).alias("q"))
    return sums.select("symbol", "center", "volume", "trades", F.round(F.col("pq") / F.col("q"), 4).alias("vwap"))


def top_symbols(t: DataFrame, found: DataFrame, n: int = 5) -> DataFrame:
    """The most active symbols by volume, trades, findings and hidden share."""
    counts = found.groupBy("symbol").agg(F.count("*").alias("anomalies"))
    sums = t.groupBy("symbol").agg(F.sum("quantity").alias("volume"), F.count("*").alias("trades"), F.coalesce(F.sum(F.when(F.col("is_hidden"), F.col("quantity"))), F.lit(0)).alias("hidden"))
    sums = sums.join(counts, "symbol", "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    score = F.log1p("volume") + F.log1p("trades") + 10 * F.col("anomalies") + 100 * F.col("hidden") / (F.col("volume") + 1)
    return sums.select("symbol", "volume", "trades", "hidden", "anomalies", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "symbol").limit(n)


def activity_profile(t: DataFrame, found: DataFrame) -> DataFrame:
    """Volume, trades and findings (trade_seq) by hour of the day and venue."""
    marked = t.join(found.select("trade_seq", F.lit(1).alias("_found")), "trade_seq", "left")
    sums = marked.groupBy(F.expr(f"ts_ns div {HOUR} % 24").alias("hour"), "venue").agg(F.sum("quantity").alias("volume"), F.count("*").alias("trades"), F.count("_found").alias("anomalies"))
    return sums.select("hour", "venue", "volume", "trades", "anomalies", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy("hour")), 6).alias("venue_share"), F.round(F.col("trades") / 3600, 6).alias("per_second"))


def _t(f):
    return lambda spark, sf: f(trades(spark, sf))


def _d(f):
    return lambda spark, sf: f(daily_trades(spark, sf))


def _b(f):
    return lambda spark, sf: f(books(spark, sf))


def _bt(f):
    return lambda spark, sf: f(books(spark, sf), trades(spark, sf))


def _book_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = book_levels(books(spark, sf))
    return r.select("symbol", "quote_seq", "visible", "spread_e4", *[F.round(c, 5).alias(c) for c in ("l1", "depth", "weighted", "spread_bps", "weighted_mid", "micro_price")])


QUERIES = {
    "book_levels": _book_rows,
    "book_l1": lambda spark, sf: quotes(spark, sf).select("symbol", "quote_seq", F.round(_imbalance(F.col("bid_size"), F.col("ask_size")), 6).alias("l1")),
    "book_flags": _b(book_flags),
    "book_pressure": _b(book_pressure),
    "book_flow": _t(flow_tumbling),
    "book_flow_anchored": _t(flow_anchored),
    "book_flow_ratio": _bt(flow_ratio),
    "book_anomaly": _bt(book_anomaly),
    "refill_patterns": lambda spark, sf: refills(orders(spark, sf), PRICE_STEP, LOOSE),
    "icebergs": lambda spark, sf: icebergs(orders(spark, sf), trades(spark, sf), PRICE_STEP, LOOSE),
    "iceberg_best": lambda spark, sf: iceberg_best(orders(spark, sf), trades(spark, sf), PRICE_STEP, LOOSE),
    "vpin_equal_buckets": lambda spark, sf: vpin_equal(daily_trades(spark, sf)).drop("last_day"),
    "vpin_rolling": _d(vpin_rolling),
    "vpin_history": lambda spark, sf: vpin_rolling(daily_trades(spark, sf)).where("bucket % 5 = 0").select("symbol", "bucket", "vpin"),
    "vpin_anomaly": lambda spark, sf: vpin_anomaly(daily_trades(spark, sf), VPIN_SIGMAS, toxic=VPIN_TOXIC),
    "vpin_exact": _d(vpin_exact),
    "daily_flow": lambda spark, sf: daily_flow(daily_trades(spark, sf), **PERIODS),
    "intraday_pin_proxy": _t(intraday_pin),
    "pin_em": lambda spark, sf: pin_em(daily_trades(spark, sf), **PERIODS),
    "pin_history": lambda spark, sf: pin_history(daily_trades(spark, sf), **PERIODS),
    "hawkes_intensity": _t(hawkes_intensity),
    "hawkes_calibration": _t(hawkes_calibration),
    "hawkes_forecast": _t(hawkes_forecast),
    "hawkes_grid": _t(hawkes_grid),
    "hawkes_ks": _t(hawkes_ks),
    "hawkes_anomaly": lambda spark, sf: hawkes_anomaly(trades(spark, sf), HAWKES_TIMES),
    "heatmap_cells": _t(heatmap_cells),
    "heatmap_summary": _t(heatmap_summary),
    "heatmap_top_symbols": lambda spark, sf: top_symbols(trades(spark, sf), tqr_anomaly(trades(spark, sf), quotes(spark, sf))),
    "activity_profile": lambda spark, sf: activity_profile(trades(spark, sf), tqr_anomaly(trades(spark, sf), quotes(spark, sf))),
}
SQL = {
    "book_levels": f"""WITH {_BOOKS_SQL} SELECT symbol, quote_seq, b + a AS visible, a0 - b0 AS spread_e4, round((bq0 - aq0) / (bq0 + aq0), 5) AS l1, round((b - a) / (b + a), 5) AS depth, round((wb - wa) / (wb + wa), 5) AS weighted,
  round((a0 - b0) * 10000 / nullif((b0 + a0) // 2, 0), 5) AS spread_bps, round((b0 * aq0 + a0 * bq0) / (bq0 + aq0), 5) AS weighted_mid, round(pq / (b + a), 5) AS micro_price FROM bk""",
    "book_l1": f"WITH {TICKS_SQL} SELECT symbol, quote_seq, round(coalesce((bid_size - ask_size) / nullif(bid_size + ask_size, 0), 0), 6) AS l1 FROM quotes",
    "book_flags": f"""WITH {_BOOKS_SQL}, w AS (SELECT *, round((wb - wa) / (wb + wa), 9) AS w FROM bk), l AS (SELECT *, lag(w) OVER (PARTITION BY symbol ORDER BY ts_ns, quote_seq) AS p FROM w)
SELECT symbol, quote_seq, b / a > 2 OR b / a < 0.5 AS unbalanced, (b + a - bq0 - aq0) / (bq0 + aq0) > 10 AS thin_top, coalesce(w * p < 0 AND abs(w) > 0.3 AND abs(p) > 0.3, false) AS flip FROM l""",
    "book_pressure": f"WITH {_PRESSURE_SQL} SELECT * FROM pr",
    "book_flow": f"WITH {_PRESSURE_SQL} SELECT * FROM fl",
    "book_flow_ratio": f"WITH {_PRESSURE_SQL} SELECT * FROM fr",
    "book_anomaly": f"""WITH {_PRESSURE_SQL}, nn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, quote_seq) AS n FROM pr JOIN fr USING (symbol, quote_seq))
SELECT symbol, quote_seq, round(0.3::DOUBLE + CASE WHEN hidden_ratio > 2 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN buildup THEN 0.3::DOUBLE ELSE 0 END, 6) AS confidence, pressure AS magnitude, round(abs(weighted) * hidden_ratio * 10000, 2) AS hidden
FROM nn WHERE n >= 10 AND abs(weighted) > 0.7 AND (hidden_ratio > 2 OR buildup)""",
    "book_flow_anchored": f"""WITH RECURSIVE {TICKS_SQL}, s AS (SELECT symbol, min(ts_ns) AS start FROM trades GROUP BY symbol
  UNION ALL SELECT * FROM (SELECT s.symbol, (SELECT min(t.ts_ns) FROM trades t WHERE t.symbol = s.symbol AND t.ts_ns > s.start + {FLOW_WINDOW}) AS start FROM s) n WHERE start IS NOT NULL),
x AS (SELECT t.*, s.start AS window_start FROM trades t ASOF JOIN s ON t.symbol = s.symbol AND t.ts_ns >= s.start)
SELECT symbol, trade_seq, ts_ns, window_start, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) OVER w::BIGINT AS bought, sum(CASE WHEN side <> 'BUY' THEN quantity ELSE 0 END) OVER w::BIGINT AS sold, sum(CASE WHEN is_hidden THEN quantity ELSE 0 END) OVER w::BIGINT AS hidden
FROM x WINDOW w AS (PARTITION BY symbol, window_start ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING)""",
    "vpin_exact": f"""WITH RECURSIVE {DAILY_SQL}, p AS (SELECT symbol, price_e4, quantity, date_diff('day', DATE '1970-01-01', day) AS d, row_number() OVER w AS n, sum(quantity) OVER w::BIGINT AS upto FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY {', '.join(DAY_ORDER)} ROWS UNBOUNDED PRECEDING)),
b AS (SELECT symbol, 0 AS bucket, 1 AS first, (SELECT min(q.n) FROM p q WHERE q.symbol = p.symbol AND (q.upto >= {BUCKET} OR q.d - p.d > 60)) AS last FROM p WHERE n = 1
  UNION ALL SELECT * FROM (SELECT a.symbol, b.bucket + 1, b.last + 1, (SELECT min(q.n) FROM p q WHERE q.symbol = a.symbol AND q.n > b.last AND (q.upto - e.upto >= {BUCKET} OR q.d - a.d > 60)) FROM b JOIN p e ON e.symbol = b.symbol AND e.n = b.last JOIN p a ON a.symbol = b.symbol AND a.n = b.last + 1) x),
r AS (SELECT p.*, b.bucket, b.last IS NOT NULL AS complete FROM p JOIN b ON p.symbol = b.symbol AND p.n >= b.first AND p.n <= coalesce(b.last, 9223372036854775807)),
m AS (SELECT symbol, bucket, min(price_e4) AS lo, CAST(trunc((max(price_e4) - min(price_e4)) * 0.01::DOUBLE) AS BIGINT) AS step, max(price_e4) AS hi, sum(quantity)::BIGINT AS volume, count(*) AS trades, bool_and(complete) AS complete FROM r GROUP BY ALL),
l AS (SELECT r.*, lo, step, CASE WHEN step = 0 THEN CASE WHEN price_e4 <= lo THEN 0 ELSE 1 END ELSE (price_e4 - lo + step - 1) // step END AS at_, CASE WHEN step = 0 THEN 1 ELSE (hi - lo) // step + 1 END AS levels FROM r JOIN m USING (symbol, bucket)),
v AS (SELECT symbol, bucket, at_, sum(quantity)::DOUBLE AS v FROM l WHERE at_ < levels GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY symbol, bucket ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER (PARTITION BY symbol, bucket) AS total FROM v),
k AS (SELECT symbol, bucket, min(at_) AS middle FROM c WHERE c >= total * 0.5 GROUP BY ALL),
f AS (SELECT symbol, bucket, coalesce(sum(quantity) FILTER (at_ < levels AND at_ > middle), 0)::DOUBLE AS buy, coalesce(sum(quantity) FILTER (at_ < levels AND at_ <= middle), 0)::DOUBLE AS sell FROM l JOIN k USING (symbol, bucket) GROUP BY ALL)
SELECT symbol, bucket, volume, trades, buy, sell, abs(buy - sell) / volume AS imbalance, complete FROM m JOIN f USING (symbol, bucket)""",
    "refill_patterns": f"WITH {_REFILL_SQL} SELECT * FROM rf",
    "icebergs": f"WITH {_REFILL_SQL} SELECT * FROM ic",
    "iceberg_best": f"""WITH {_REFILL_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence * estimated DESC, level, side DESC) AS k FROM ic)
SELECT symbol, side, level, ts_ns, confidence, round(estimated / visible, 6) AS magnitude, estimated - executed AS hidden FROM k WHERE k = 1 AND confidence > 0.7""",
    "vpin_equal_buckets": f"WITH {_VPIN_SQL} SELECT * EXCLUDE (last_day) FROM vi",
    "vpin_rolling": f"WITH {_VPIN_SQL} SELECT * FROM vr",
    "vpin_history": f"WITH {_VPIN_SQL} SELECT symbol, bucket, vpin FROM vr WHERE bucket % 5 = 0",
    "vpin_anomaly": f"WITH {_VPIN_SQL} SELECT symbol, bucket, last_day, round(least(1.0::DOUBLE, z / 4), 6) AS confidence, round(vpin / {VPIN_TOXIC}::DOUBLE, 5) AS magnitude, round(imbalance * {BUCKET} * 10, 1) AS hidden FROM vr JOIN vi USING (symbol, bucket) WHERE vpin > {VPIN_TOXIC} AND z > {VPIN_SIGMAS}",
    "daily_flow": f"""WITH {DAILY_SQL} SELECT symbol, date_trunc('month', day)::DATE AS period, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, coalesce(sum(quantity) FILTER (side = 'BUY'), 0)::BIGINT AS buy_volume,
  coalesce(sum(quantity) FILTER (side = 'SELL'), 0)::BIGINT AS sell_volume, count(*) AS trades FROM daily GROUP BY 1, 2 HAVING count(*) >= 20 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period DESC) <= {PIN_KEPT}""",
    "intraday_pin_proxy": f"""WITH {TICKS_SQL}, h AS (SELECT symbol, ts_ns // {HOUR} % 24 AS hour, count(*) FILTER (side = 'BUY') AS b, count(*) FILTER (side = 'SELL') AS s FROM trades GROUP BY ALL),
p AS (SELECT *, CASE WHEN b + s > 10 THEN 0.5::DOUBLE * abs(b - s) / (b + s) ELSE 0 END AS pin FROM h) SELECT symbol, hour, b, s, round(pin, 6) AS pin, round(sum(pin) OVER (PARTITION BY symbol) / 24, 6) AS daily_average, round(pin, 6) > 2 * round(sum(pin) OVER (PARTITION BY symbol) / 24, 6) AND round(pin, 6) > 0.2 AS spike FROM p""",
    "hawkes_intensity": f"WITH {_HAWKES_SQL} SELECT * FROM hi",
    "hawkes_calibration": f"WITH {_HAWKES_SQL} SELECT * FROM hc",
    "hawkes_forecast": f"""WITH {_HAWKES_SQL}, n AS (SELECT symbol, buy + sell AS now_ FROM hi JOIN (SELECT symbol, trade_seq FROM he WHERE k = 1) USING (symbol, trade_seq)),
f AS (SELECT symbol, baseline, unnest(range(1, 11)) AS step, beta, now_ FROM hc JOIN n USING (symbol)), v AS (SELECT *, baseline + (now_ - baseline) * exp(-beta * step * 5.0::DOUBLE) AS v FROM f)
SELECT symbol, step, round(v, 5) AS expected, round(greatest(0, v - 2 * sqrt(baseline)), 5) AS low, round(v + 2 * sqrt(baseline), 5) AS high FROM v""",
    "hawkes_grid": f"""WITH {_HAWKES_SQL}, g AS (SELECT symbol, unnest(range(0, 100)) AS point, max(ts_ns) AS e FROM he GROUP BY symbol), a AS (SELECT symbol, point, e - (99 - point) * {400 * MINUTE} AS g_at FROM g)
SELECT a.symbol, point, round(2 * {MU}::DOUBLE + {ALPHA + CROSS}::DOUBLE * coalesce(sum(m * {BETA}::DOUBLE * exp(-{BETA}::DOUBLE * (g_at - ts_ns)::DOUBLE / {float(MINUTE)})), 0), 5) AS total
FROM a LEFT JOIN he ON he.symbol = a.symbol AND ts_ns < g_at AND ts_ns >= g_at - {4000 * MINUTE} GROUP BY ALL""",
    "hawkes_ks": f"""WITH {_HAWKES_SQL}, d AS (SELECT symbol, trade_seq, side, (ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq))::DOUBLE / {float(MINUTE)} AS dt FROM he),
r AS (SELECT symbol, trade_seq, round(1 - exp(-CASE WHEN side = 'BUY' THEN buy ELSE sell END * dt), 6) AS r FROM d JOIN hi USING (symbol, trade_seq) WHERE dt IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r, trade_seq) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r) SELECT symbol, count(*) AS n, round(max(abs(i / n - r)), 5) AS ks FROM i WHERE n >= 19 GROUP BY symbol""",
    "hawkes_anomaly": f"""WITH {_HAWKES_SQL}, x AS (SELECT *, buy + sell AS total, {HAWKES_TIMES}::DOUBLE * baseline AS lim FROM hi JOIN (SELECT he.symbol, CASE WHEN any_value(baseline) > 0 THEN any_value(baseline) ELSE {MU}::DOUBLE END AS baseline, coalesce(any_value(branching), 0) AS branching FROM he LEFT JOIN hc USING (symbol) GROUP BY 1 HAVING count(*) >= 20) USING (symbol))
SELECT symbol, trade_seq, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (total / lim - 1) * (1 - branching))), 4) AS confidence, round(total / baseline, 3) AS magnitude,
  round((total - baseline) * 100000, 1) AS hidden, CASE WHEN buy_share > 0.6 THEN 'buy' WHEN buy_share < 0.4 THEN 'sell' ELSE 'mixed' END AS direction FROM x WHERE total > lim""",
    "heatmap_cells": f"""WITH {TICKS_SQL}, f AS (SELECT symbol, arg_min(price_e4, ts_ns) AS center, max(ts_ns) AS as_of FROM trades GROUP BY 1),
c AS (SELECT t.*, (as_of - ts_ns) // {12 * HOUR} AS age, least(99, greatest(0, coalesce(CAST(trunc((price_e4 - center) / nullif(center, 0) / 0.01::DOUBLE) AS BIGINT), 0) + 50)) AS cell FROM trades t JOIN f USING (symbol)),
s AS (SELECT symbol, age, cell, coalesce(sum(quantity) FILTER (side = 'BUY'), 0)::BIGINT AS bought, coalesce(sum(quantity) FILTER (side <> 'BUY'), 0)::BIGINT AS sold, coalesce(sum(quantity) FILTER (is_hidden), 0)::BIGINT AS hidden, count(*) AS trades FROM c WHERE age < 60 GROUP BY ALL)
SELECT *, least(1000000, (bought + sold) * CAST(round(pow(0.95::DOUBLE, age) * 1e9) AS BIGINT) // 100000000) / 1e6 AS intensity FROM s""",
    "heatmap_summary": f"""WITH {TICKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC, trade_seq DESC) AS k FROM trades)
SELECT symbol, arg_min(price_e4, ts_ns) AS center, sum(quantity)::BIGINT AS volume, count(*) AS trades, round(sum(price_e4 * quantity) FILTER (k <= 1000)::DOUBLE / sum(quantity) FILTER (k <= 1000)::DOUBLE, 4) AS vwap FROM k GROUP BY symbol""",
    "heatmap_top_symbols": f"""WITH {TICKS_SQL}, s AS (SELECT symbol, sum(quantity)::BIGINT AS volume, count(*) AS trades, coalesce(sum(quantity) FILTER (is_hidden), 0)::BIGINT AS hidden FROM trades GROUP BY symbol),
a AS (SELECT symbol, count(*) AS anomalies FROM ({TRADING_SQL['tqr_anomaly']}) GROUP BY symbol), j AS (SELECT s.*, coalesce(anomalies, 0) AS anomalies FROM s LEFT JOIN a USING (symbol))
SELECT *, round(ln(1 + volume) + ln(1 + trades) + 10 * anomalies + 100 * hidden / (volume + 1), 6) AS score FROM j ORDER BY score DESC, symbol LIMIT 5""",
    "activity_profile": f"""WITH {TICKS_SQL}, s AS (SELECT ts_ns // {HOUR} % 24 AS hour, venue, sum(quantity)::BIGINT AS volume, count(*) AS trades, count(a.trade_seq) AS anomalies FROM trades LEFT JOIN (SELECT trade_seq FROM ({TRADING_SQL['tqr_anomaly']})) a USING (trade_seq) GROUP BY ALL)
SELECT *, round(volume / sum(volume) OVER (PARTITION BY hour), 6) AS venue_share, round(trades / 3600, 6) AS per_second FROM s""",
}
