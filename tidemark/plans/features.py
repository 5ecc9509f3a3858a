"""The feature catalogue: groups of named values at each trade, and the vector of 128."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import day_second, ratio, rows_back, up_to_now
from tidemark.operators.asof import asof
from tidemark.sources.adapters import HOUR, TICKS_SQL, quotes, trades

ORDER = ("ts_ns", "trade_seq")
DAY = 24 * HOUR
LOOKBACKS = (10, 20, 50, 100)
WIDTH = 128
NAMES = {
    "microstructure": ("spread", "spread_bps", "effective_spread", "depth", "depth_imbalance", "weighted_mid", "micro_price", "quote_intensity"),
    "order_flow": ("trade_intensity", "avg_trade_size", "large_trade_ratio", "buy_sell_imbalance", "signed_volume", "toxicity", "kyle_lambda", "arrival_rate"),
    "price": ("return_1m", "return_5m", "return_30m", "volatility_1m", "volatility_5m", "volatility_30m", "momentum", "acceleration"),
    "volume": ("volume_rate", "vwap", "twap", "volume_skew", "participation", "relative_volume", "concentration", "cumulative_delta"),
    "temporal": ("time_sin", "time_cos", "day_of_week", "since_open", "to_close", "intraday", "seasonal", "since_event"),
    "cross": ("market_correlation", "sector_beta", "relative_strength", "cross_asset_flow", "market_impact", "systematic", "idiosyncratic_vol", "contagion"),
    "derived": ("tqr", "vpin", "pin", "hawkes", "hmm_state", "drift", "refill", "clustering"),
    "statistical": ("kurtosis", "skewness", "jarque_bera", "hurst", "entropy", "fractal", "lyapunov", "autocorrelation"),
}


def _w(n: int):
    return rows_back(n, "symbol", order=ORDER)


def _sums(window, *exprs):
    return [F.sum(e).over(window) for e in exprs]


def price_features(t: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns over 10, 50 and 300 trades, realised volatilities, momentum of three means, acceleration."""
    one = Window.partitionBy("symbol").orderBy(*ORDER)
    p = F.col("price_e4").cast("double")
    rows = t.select("symbol", *ORDER, "price_e4", *[c for c in keep if c != "price_e4"], *[F.lag("price_e4", n).over(one).alias(f"p{n}") for n in (1, 10, 50, 300)])
    rows = rows.withColumn("r", F.ln(ratio(p, F.col("p1"))))
    change = lambda n: F.coalesce(ratio(p - F.col(f"p{n}"), F.col(f"p{n}")), F.lit(0.0))
    vol = lambda n: F.when(F.count("r").over(_w(n)) == n, F.sqrt(F.avg(F.col("r") * F.col("r")).over(_w(n)))).otherwise(0.0)
    mean = lambda n: F.avg("price_e4").over(_w(n))
    rows = rows.select("symbol", *ORDER, *keep, change(10).alias("return_1m"), change(50).alias("return_5m"), change(300).alias("return_30m"), vol(10).alias("volatility_1m"), vol(50).alias("volatility_5m"), vol(100).alias("volatility_30m"), F.coalesce(ratio(mean(10) - mean(50), mean(50)), F.lit(0.0)).alias("momentum"))
    return rows.withColumn("acceleration", F.coalesce(F.col("momentum") - F.lag("momentum", 10).over(one), F.lit(0.0)))


def volume_features(t: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rates, prices weighted by volume and time, skew, participation, concentration, cumulative delta."""
    q, p = F.col("quantity").cast("double"), F.col("price_e4").cast("double")
    ever = up_to_now("symbol", order=ORDER)
    w100, w50, w20 = _w(100), _w(50), _w(20)
    n, s1, s2, s3 = F.count("*").over(w100), *_sums(w100, q, q * q, q * q * q)
    m = s1 / n
    var = s2 / n - m * m
    skew = F.when(var > 1e-9, (s3 / n - 3 * m * s2 / n + 2 * m * m * m) / F.pow(F.greatest(var, F.lit(1e-9)), F.lit(1.5))).otherwise(0.0)
    seconds = (F.col("ts_ns") - F.min("ts_ns").over(ever)) / 1e9
    total, count = F.sum("quantity").over(ever), F.count("*").over(ever)
    rate = total / (seconds + 1)
    delta = F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).when(F.col("side") == "SELL", -F.col("quantity")).otherwise(0)).over(ever)
    return t.select(
        "symbol", *ORDER, *keep, rate.alias("volume_rate"), (F.sum(p * q).over(w100) / s1).alias("vwap"), F.avg(p).over(w100).alias("twap"), skew.alias("volume_skew"), (F.sum("quantity").over(w20) / (total + 1)).alias("participation"),
        (rate / (total / count + 1)).alias("relative_volume"), (F.sum(q * q).over(w50) / F.pow(F.sum(q).over(w50), F.lit(2.0))).alias("concentration"), delta.cast("double").alias("cumulative_delta"),
    )


def flow_features(t: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Intensity, sizes, large trades (over twice the mean, of a hundred), signed flow, toxicity, price impact."""
    ever, w100, w50 = up_to_now("symbol", order=ORDER), _w(100), _w(50)
    one = Window.partitionBy("symbol").orderBy(*ORDER)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).when(F.col("side") == "SELL", -F.col("quantity")).otherwise(0)
    rows = t.select("symbol", *ORDER, "quantity", *[c for c in keep if c != "quantity"], signed.alias("sv"), (F.col("price_e4") - F.lag("price_e4").over(one)).cast("double").alias("dp"), F.avg("quantity").over(w100).alias("m"))
    seconds = (F.col("ts_ns") - F.min("ts_ns").over(ever)) / 1e9
    intensity = F.count("*").over(ever) / (seconds + 1)
    imbalance = F.sum("sv").over(ever) / F.sum("quantity").over(ever)
    n = F.count("dp").over(w50)
    v = F.when(F.col("dp").isNotNull(), F.col("sv").cast("double"))
    sx, sy, sxy, sxx = _sums(w50, v, F.col("dp"), v * F.col("dp"), v * v)
    slope = F.coalesce(ratio(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))
    return rows.select(
        "symbol", *ORDER, *keep, intensity.alias("trade_intensity"), (F.sum("quantity").over(ever) / (F.count("*").over(ever) + 1)).alias("avg_trade_size"), (F.count_if(F.col("quantity") > 2 * F.col("m")).over(w100) / 100).alias("large_trade_ratio"),
        imbalance.alias("buy_sell_imbalance"), F.sum("sv").over(w100).cast("double").alias("signed_volume"), (F.abs(imbalance) * intensity / 100).alias("toxicity"), slope.alias("kyle_lambda"), intensity.alias("arrival_rate"),
    )


def time_features(t: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Time of day on a circle, day of the week, hours since the open (09:30) and to the close (16:00), season."""
    sec = day_second(F.col("ts_ns"))
    days = F.floor(F.col("ts_ns") / DAY)
    angle = 2 * np.pi * sec / 86400
    since, left = (sec - 34200) / 3600.0, (57600 - sec) / 3600.0
    year_day = F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    return t.select(
        "symbol", *ORDER, *keep, F.sin(angle).alias("time_sin"), F.cos(angle).alias("time_cos"), ((days + 4) % 7).cast("double").alias("day_of_week"), since.alias("since_open"), left.alias("to_close"),
        (F.exp(-F.greatest(since, F.lit(0.0)) / 2) + F.exp(-F.greatest(left, F.lit(0.0)) / 2)).alias("intraday"), F.sin(2 * np.pi * year_day / 365).alias("seasonal"), F.lit(0.0).alias("since_event"),
    )


def micro_features(t: DataFrame, q: DataFrame) -> DataFrame:
    """Spread, depth and weighted prices of the quote that holds at each trade."""
    half = Window.partitionBy("symbol").orderBy("ts_ns", "quote_seq")
    gap = F.col("ask_e4") - F.col("bid_e4")
    recent = F.reverse(F.collect_list(gap.cast("double")).over(half.rowsBetween(-9, 0)))
    up = F.aggregate(F.transform("_g", lambda x, i: x * F.pow(F.lit(0.9), i.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    down = F.aggregate(F.transform("_g", lambda x, i: F.pow(F.lit(0.9), i.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    rich = q.withColumn("_g", recent).withColumn("effective", up / down / 10000).withColumn("n_quotes", F.row_number().over(half).cast("long")).withColumn("first_ts", F.min("ts_ns").over(Window.partitionBy("symbol")))
    take = {c: c for c in ("bid_e4", "ask_e4", "bid_size", "ask_size", "effective", "n_quotes", "first_ts")}
    rows = asof(t.select("symbol", *ORDER), rich, ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], take, DAY).where("bid_e4 is not null")
    depth = F.col("bid_size") + F.col("ask_size")
    mid = (F.col("bid_e4") + F.col("ask_e4")) / 2.0
    cross = (F.col("bid_e4") * F.col("ask_size") + F.col("ask_e4") * F.col("bid_size")) / depth
    level = (F.col("bid_e4") * F.col("bid_size") + F.col("ask_e4") * F.col("ask_size")) / depth
    return rows.select(
        "symbol", *ORDER, (gap / 10000).alias("spread"), F.coalesce(ratio(gap * 10000, mid), F.lit(0.0)).alias("spread_bps"), F.col("effective").alias("effective_spread"), depth.cast("double").alias("depth"),
        ((F.col("bid_size") - F.col("ask_size")) / depth).alias("depth_imbalance"), cross.alias("weighted_mid"), level.alias("micro_price"), (F.col("n_quotes") / ((F.col("ts_ns") - F.col("first_ts")) / 1e9 + 1)).alias("quote_intensity"),
    )


def stat_features(t: DataFrame, n: int = 100) -> DataFrame:
    """Moments, Jarque-Bera and first autocorrelation of the last hundred log returns; entropy of their histogram."""
    one = Window.partitionBy("symbol").orderBy(*ORDER)
    rows = t.select("symbol", *ORDER, F.ln(ratio(F.col("price_e4"), F.lag("price_e4").over(one))).alias("r"))
    rows = rows.withColumn("r0", F.lag("r").over(one)).where("r is not null")
    w, r = _w(n), F.col("r")
    k = F.count("r").over(w)
    s1, s2, s3, s4 = _sums(w, r, r * r, r * r * r, r * r * r * r)
    m = s1 / k
    var = s2 / k - m * m
    third = s3 / k - 3 * m * s2 / k + 2 * m * m * m
    fourth = s4 / k - 4 * m * s3 / k + 6 * m * m * s2 / k - 3 * m * m * m * m
    safe = F.greatest(var, F.lit(1e-18))
    rows = rows.select("symbol", *ORDER, k.alias("n"), F.when(var > 1e-12, third / F.pow(safe, F.lit(1.5))).otherwise(0.0).alias("skewness"), F.when(var > 1e-12, fourth / (safe * safe) - 3).otherwise(0.0).alias("kurtosis"),
                       F.collect_list("r").over(w).alias("_r"), F.min("r").over(w).alias("lo"), F.max("r").over(w).alias("hi"), F.when(var > 1e-12, ((F.sum(r * F.col("r0")).over(w) - m * F.sum("r0").over(w)) / k) / safe).otherwise(0.0).alias("autocorrelation"))
    bins = F.transform("_r", lambda x: F.least(F.lit(9), F.floor((x - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-18)) * 10).cast("int")))
    rows = rows.withColumn("_b", bins)
    share = lambda b: F.size(F.filter("_b", lambda x: x == b)) / F.size("_b")
    parts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.when(share(b) > 0, -share(b) * F.log2(share(b))).otherwise(0.0))
    entropy = F.when(F.col("hi") > F.col("lo"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    bera = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return rows.select("symbol", *ORDER, "n", "skewness", "kurtosis", bera.alias("jarque_bera"), entropy.alias("entropy"), "autocorrelation")


SPANS = (4, 8, 16)


def hurst_rows(x: np.ndarray) -> np.ndarray:
    """For each row of values: slope of log R/S over log n for windows of 4, 8 and 16; a half where it is undefined."""
    logs = []
    for n in SPANS:
        if x.shape[1] < n:
            logs.append(np.full(len(x), np.nan))
            continue
        parts = x[:, : x.shape[1] // n * n].reshape(len(x), -1, n)
        walk = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
        sd = parts.std(axis=2)
        ok = sd > 1e-12
        scaled = np.where(ok, (walk.max(axis=2) - walk.min(axis=2)) / np.where(ok, sd, 1.0), 0.0)
        count = ok.sum(axis=1)
        mean = scaled.sum(axis=1) / np.maximum(count, 1)
        logs.append(np.where((count > 0) & (mean > 0), np.log(np.maximum(mean, 1e-300)), np.nan))
    y = np.stack(logs, axis=1)
    known = ~np.isnan(y)
    at, count = np.log(np.array(SPANS, float))[None], np.maximum(known.sum(axis=1), 1)[:, None]
    dx = np.where(known, at - np.where(known, at, 0).sum(axis=1, keepdims=True) / count, 0.0)
    dy = np.where(known, y, 0.0) - np.where(known, y, 0.0).sum(axis=1, keepdims=True) / count
    spread = (dx * dx).sum(axis=1)
    slope = (dx * np.where(known, dy, 0.0)).sum(axis=1) / np.where(spread > 0, spread, 1.0)
    return np.where(known.sum(axis=1) >= 2, np.clip(slope, 0.0, 1.0), 0.5)


def lyapunov_rows(x: np.ndarray) -> np.ndarray:
    """For each row of values the mean log growth of its changes; 0 without any."""
    d = np.abs(np.diff(x, axis=1))
    if d.shape[1] < 2:
        return np.zeros(len(x))
    ok = (d[:, :-1] > 1e-12) & (d[:, 1:] > 1e-12)
    growth = np.where(ok, np.log(np.where(ok, d[:, 1:], 1.0) / np.where(ok, d[:, :-1], 1.0)), 0.0)
    return growth.sum(axis=1) / np.maximum(ok.sum(axis=1), 1)


def hurst(x: np.ndarray) -> float:
    return float(hurst_rows(np.asarray(x, float)[None])[0]) if len(x) else 0.5


def hurst_features(t: DataFrame, n: int = 100, block: int = 5000) -> DataFrame:
    """Hurst exponent, fractal dimension and a Lyapunov proxy (mean log growth of changes) of the last hundred returns."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(ORDER))
        price = g.price_e4.to_numpy(float)
        r = np.diff(np.log(np.where(price > 0, price, np.nan)))
        h, l = np.full(len(g), 0.5), np.zeros(len(g))  # noqa: E741
        if len(r) >= n:  # row k + n has the window r[k : k + n]
            windows = np.lib.stride_tricks.sliding_window_view(r, n)
            for a in range(0, len(windows), block):
                h[a + n : a + n + block], l[a + n : a + n + block] = hurst_rows(windows[a : a + block]), lyapunov_rows(windows[a : a + block])
        holes = np.concatenate([[0], np.cumsum(np.isnan(r))])
        for k in range(len(g)):  # shorter windows, and those with a price of 0 in them
            a = max(0, k - n)
            if k < n or holes[k] > holes[a]:
                x = r[a:k][~np.isnan(r[a:k])]
                h[k], l[k] = (hurst_rows(x[None])[0], lyapunov_rows(x[None])[0]) if len(x) else (0.5, 0.0)
        return pd.concat([g[["symbol", *ORDER]], pd.DataFrame({"hurst": h, "lyapunov": l, "fractal": 2 - h}, index=g.index)], axis=1)

    return t.select("symbol", *ORDER, "price_e4").groupBy("symbol").applyInPandas(walk, "symbol long, ts_ns long, trade_seq long, hurst double, lyapunov double, fractal double")


def spread_features(t: DataFrame, q: DataFrame) -> DataFrame:
    """Mean and deviation of the spreads of the last quotes up to each trade, over each lookback; 0 without a quote."""
    gap = (F.col("ask_e4") - F.col("bid_e4")).cast("double")
    w = lambda n: rows_back(n, "symbol", order=("ts_ns", "quote_seq"))
    rich = q.select("symbol", "ts_ns", "quote_seq", *[f(gap).over(w(n)).alias(f"spread_{k}_{n}") for n in LOOKBACKS for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    names = [f"spread_{k}_{n}" for n in LOOKBACKS for k in ("mean", "std")]
    rows = asof(t.select("symbol", *ORDER), rich, ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], {n: n for n in names}, DAY)
    return rows.select("symbol", *ORDER, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def lookback_features(t: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation and index percentiles of price, mean and deviation of volume, over each lookback."""
    p, q = F.col("price_e4").cast("double"), F.col("quantity").cast("double")
    out = []
    for n in LOOKBACKS:
        w = _w(n)
        s = F.sort_array(F.collect_list("price_e4").over(w))
        at = lambda share, s=s: F.element_at(s, F.floor((F.size(s) - 1) * share).cast("int") + 1)
        out += [F.avg(p).over(w).alias(f"price_mean_{n}"), F.stddev_pop(p).over(w).alias(f"price_std_{n}"), at(0.95).alias(f"price_p95_{n}"), at(0.05).alias(f"price_p05_{n}"), F.avg(q).over(w).alias(f"volume_mean_{n}"), F.stddev_pop(q).over(w).alias(f"volume_std_{n}")]
    return t.select("symbol", *ORDER, *keep, *out)


def feature_vector(t: DataFrame, q: DataFrame) -> DataFrame:
    """All groups side by side as one array of 128 doubles, in the catalogue's order; what is not computed is 0."""
    on = ["symbol", *ORDER]
    base = ("side", "price_e4", "quantity")
    rows = t.select(*on, *base)
    for part in (price_features, volume_features, flow_features, lookback_features, time_features):  # one order of rows, one exchange
        rows = part(rows, tuple(c for c in rows.columns if c not in on))
    for part in (micro_features(t, q), spread_features(t, q), stat_features(t).drop("n"), hurst_features(t)):
        rows = rows.join(part, on, "left")
    c = F.col
    state = F.when(c("volatility_1m") > 2 * c("volatility_5m"), 2.0).when(c("buy_sell_imbalance") > 0.5, 1.0).otherwise(0.0)
    derived = {
        "tqr": c("trade_intensity") / (F.coalesce("quote_intensity", F.lit(0.0)) + 1), "vpin": c("toxicity"), "pin": 1 / (1 + F.exp(-5 * (c("large_trade_ratio") - 0.2))), "hawkes": c("arrival_rate") * (1 + 0.5 * c("concentration")), "hmm_state": state,
        "drift": F.abs("momentum") * c("volume_rate"), "refill": c("large_trade_ratio") * c("concentration"), "clustering": F.coalesce("autocorrelation", F.lit(0.0)) * c("participation"),
    }
    named = [F.lit(0.0) if g == "cross" else derived[n] if g == "derived" else c(n) for g, names in NAMES.items() for n in names]
    late = [c(f"{k}_{n}") for n in LOOKBACKS for k in ("price_mean", "price_std", "price_p95", "price_p05", "volume_mean", "volume_std", "spread_mean", "spread_std")]
    values = [F.coalesce(v.cast("double"), F.lit(0.0)) for v in [*named, *late]]
    return rows.select(*on, F.array(*values, *[F.lit(0.0)] * (WIDTH - len(values))).alias("features"))


def _round(f, digits: int = 6, *, two: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = f(trades(spark, sf), quotes(spark, sf)) if two else f(trades(spark, sf))
        return rows.select("symbol", "trade_seq", *[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in rows.dtypes if n not in ("symbol", "ts_ns", "trade_seq")])

    return run


def _over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ALL = "(PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING)"
_ONE = "(PARTITION BY symbol ORDER BY ts_ns, trade_seq)"
_SIGNED = "CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END"

QUERIES = {
    "features_price": _round(price_features),
    "features_volume": _round(volume_features, 4),
    "features_flow": _round(flow_features, 5),
    "features_time": _round(time_features),
    "features_micro": _round(micro_features, 4, two=True),
    "features_stat": _round(stat_features, 4),
    "features_lookback": _round(lookback_features, 3),
    "features_spread": _round(spread_features, 3, two=True),
    "features_hurst": lambda spark, sf: hurst_features(trades(spark, sf)),
    "feature_vector": lambda spark, sf: feature_vector(trades(spark, sf), quotes(spark, sf)),
}
SQL = {
    "features_price": f"""WITH {TICKS_SQL}, l AS (SELECT *, ln(nullif(price_e4, 0)::DOUBLE / nullif(lag(price_e4) OVER {_ONE}, 0)) AS r FROM trades),
c AS (SELECT symbol, ts_ns, trade_seq, {', '.join(f'coalesce((price_e4 - lag(price_e4, {n}) OVER {_ONE})::DOUBLE / nullif(lag(price_e4, {n}) OVER {_ONE}, 0), 0) AS return_{m}' for n, m in ((10, '1m'), (50, '5m'), (300, '30m')))},
  {', '.join(f'CASE WHEN count(r) OVER {_over(n)} = {n} THEN sqrt(avg(r * r) OVER {_over(n)}) ELSE 0 END AS volatility_{m}' for n, m in ((10, '1m'), (50, '5m'), (100, '30m')))},
  coalesce((avg(price_e4) OVER {_over(10)} - avg(price_e4) OVER {_over(50)}) / nullif(avg(price_e4) OVER {_over(50)}, 0), 0) AS momentum FROM l),
a AS (SELECT *, coalesce(momentum - lag(momentum, 10) OVER {_ONE}, 0) AS acceleration FROM c)
SELECT symbol, trade_seq, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES['price'])} FROM a""",
    "features_volume": f"""WITH {TICKS_SQL}, x AS (SELECT symbol, ts_ns, trade_seq, count(*) OVER {_over(100)} AS n, sum(quantity::DOUBLE) OVER {_over(100)} AS s1, sum(quantity::DOUBLE * quantity) OVER {_over(100)} AS s2, sum(quantity::DOUBLE * quantity * quantity) OVER {_over(100)} AS s3,
  sum(price_e4::DOUBLE * quantity) OVER {_over(100)} AS pq, avg(price_e4) OVER {_over(100)} AS twap, sum(quantity) OVER {_over(20)} AS v20, sum(quantity::DOUBLE) OVER {_over(50)} AS v50, sum(quantity::DOUBLE * quantity) OVER {_over(50)} AS vv50,
  sum(quantity) OVER {_ALL} AS total, count(*) OVER {_ALL} AS cnt, (ts_ns - min(ts_ns) OVER {_ALL}) / 1e9 AS sec, sum({_SIGNED}) OVER {_ALL} AS delta FROM trades),
y AS (SELECT *, s2 / n - (s1 / n) * (s1 / n) AS var FROM x)
SELECT symbol, trade_seq, round(total / (sec + 1), 4) AS volume_rate, round(pq / s1, 4) AS vwap, round(twap, 4) AS twap, round(CASE WHEN var > 1e-9 THEN (s3 / n - 3 * (s1 / n) * s2 / n + 2 * pow(s1 / n, 3)) / pow(var, 1.5) ELSE 0 END, 4) AS volume_skew,
  round(v20 / (total + 1), 4) AS participation, round(total / (sec + 1) / (total / cnt + 1), 4) AS relative_volume, round(vv50 / (v50 * v50), 4) AS concentration, delta::DOUBLE AS cumulative_delta FROM y""",
    "features_flow": f"""WITH {TICKS_SQL}, x AS (SELECT symbol, ts_ns, trade_seq, quantity, {_SIGNED} AS sv, (price_e4 - lag(price_e4) OVER {_ONE})::DOUBLE AS dp, avg(quantity) OVER {_over(100)} AS m FROM trades),
z AS (SELECT *, CASE WHEN dp IS NOT NULL THEN sv::DOUBLE END AS v FROM x),
y AS (SELECT symbol, trade_seq, count(*) OVER {_ALL} / ((ts_ns - min(ts_ns) OVER {_ALL}) / 1e9 + 1) AS ti, sum(quantity) OVER {_ALL} / (count(*) OVER {_ALL} + 1) AS ats, count(*) FILTER (quantity > 2 * m) OVER {_over(100)} / 100 AS lr, sum(sv) OVER {_ALL} / sum(quantity) OVER {_ALL} AS im,
  sum(sv) OVER {_over(100)} AS sg, count(dp) OVER {_over(50)} AS n, sum(v) OVER {_over(50)} AS sx, sum(dp) OVER {_over(50)} AS sy, sum(v * dp) OVER {_over(50)} AS sxy, sum(v * v) OVER {_over(50)} AS sxx FROM z)
SELECT symbol, trade_seq, round(ti, 5) AS trade_intensity, round(ats, 5) AS avg_trade_size, round(lr, 5) AS large_trade_ratio, round(im, 5) AS buy_sell_imbalance, sg::DOUBLE AS signed_volume, round(abs(im) * ti / 100, 5) AS toxicity,
  round(coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0), 5) AS kyle_lambda, round(ti, 5) AS arrival_rate FROM y""",
    "features_time": f"""WITH {TICKS_SQL}, x AS (SELECT symbol, trade_seq, ts_ns // 1000000000 % 86400 AS s, ts_ns // {DAY} AS d FROM trades), y AS (SELECT *, (s - 34200) / 3600.0::DOUBLE AS a, (57600 - s) / 3600.0::DOUBLE AS b FROM x)
SELECT symbol, trade_seq, round(sin(2 * pi() * s / 86400), 6) AS time_sin, round(cos(2 * pi() * s / 86400), 6) AS time_cos, ((d + 4) % 7)::DOUBLE AS day_of_week, round(a, 6) AS since_open, round(b, 6) AS to_close,
  round(exp(-greatest(a, 0) / 2) + exp(-greatest(b, 0) / 2), 6) AS intraday, round(sin(2 * pi() * dayofyear(DATE '1970-01-01' + d::INT) / 365), 6) AS seasonal, 0.0::DOUBLE AS since_event FROM y""",
    "features_micro": f"""WITH {TICKS_SQL}, e AS (SELECT *, row_number() OVER o AS n, min(ts_ns) OVER (PARTITION BY symbol) AS first_ts FROM quotes WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, quote_seq)),
g AS (SELECT a.symbol, a.quote_seq, sum((b.ask_e4 - b.bid_e4) * pow(0.9::DOUBLE, a.n - b.n)) / sum(pow(0.9::DOUBLE, a.n - b.n)) / 10000 AS eff FROM e a JOIN e b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 9 AND a.n GROUP BY ALL),
r AS (SELECT e.*, eff FROM e JOIN g USING (symbol, quote_seq)), x AS (SELECT t.symbol, t.trade_seq, t.ts_ns AS at_ns, r.* EXCLUDE (symbol) FROM trades t ASOF JOIN r ON t.symbol = r.symbol AND t.ts_ns >= r.ts_ns)
SELECT symbol, trade_seq, round((ask_e4 - bid_e4) / 10000, 4) AS spread, round(coalesce((ask_e4 - bid_e4) * 10000 / nullif((bid_e4 + ask_e4) / 2.0::DOUBLE, 0), 0), 4) AS spread_bps, round(eff, 4) AS effective_spread, (bid_size + ask_size)::DOUBLE AS depth,
  round((bid_size - ask_size) / (bid_size + ask_size), 4) AS depth_imbalance, round((bid_e4 * ask_size + ask_e4 * bid_size) / (bid_size + ask_size), 4) AS weighted_mid, round((bid_e4 * bid_size + ask_e4 * ask_size) / (bid_size + ask_size), 4) AS micro_price,
  round(n / ((at_ns - first_ts) / 1e9 + 1), 4) AS quote_intensity FROM x""",
    "features_lookback": f"WITH {TICKS_SQL} SELECT symbol, trade_seq, "
    + ", ".join(
        f"round(avg(price_e4) OVER {_over(n)}, 3) AS price_mean_{n}, round(stddev_pop(price_e4::DOUBLE) OVER {_over(n)}, 3) AS price_std_{n}, list_sort(list(price_e4) OVER {_over(n)})[floor((count(*) OVER {_over(n)} - 1) * 0.95::DOUBLE)::BIGINT + 1] AS price_p95_{n}, "
        f"list_sort(list(price_e4) OVER {_over(n)})[floor((count(*) OVER {_over(n)} - 1) * 0.05::DOUBLE)::BIGINT + 1] AS price_p05_{n}, round(avg(quantity) OVER {_over(n)}, 3) AS volume_mean_{n}, round(stddev_pop(quantity::DOUBLE) OVER {_over(n)}, 3) AS volume_std_{n}"
        for n in LOOKBACKS
    )
    + " FROM trades",
    "features_spread": f"WITH {TICKS_SQL}, r AS (SELECT symbol, ts_ns, "
    + ", ".join(f"avg((ask_e4 - bid_e4)::DOUBLE) OVER (PARTITION BY symbol ORDER BY ts_ns, quote_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}, stddev_pop((ask_e4 - bid_e4)::DOUBLE) OVER (PARTITION BY symbol ORDER BY ts_ns, quote_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s{n}" for n in LOOKBACKS)
    + " FROM quotes) SELECT t.symbol, trade_seq, "
    + ", ".join(f"round(coalesce(m{n}, 0), 3) AS spread_mean_{n}, round(coalesce(s{n}, 0), 3) AS spread_std_{n}" for n in LOOKBACKS)
    + " FROM trades t ASOF LEFT JOIN r ON t.symbol = r.symbol AND t.ts_ns >= r.ts_ns",
    "features_stat": f"""WITH {TICKS_SQL}, a AS (SELECT symbol, ts_ns, trade_seq, ln(nullif(price_e4, 0)::DOUBLE / nullif(lag(price_e4) OVER {_ONE}, 0)) AS r FROM trades), b AS (SELECT *, lag(r) OVER {_ONE} AS r0 FROM a),
c AS (SELECT symbol, ts_ns, trade_seq, r, count(r) OVER w AS n, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2, sum(r * r * r) OVER w AS s3, sum(r * r * r * r) OVER w AS s4, sum(r * r0) OVER w AS c1, sum(r0) OVER w AS c0, min(r) OVER w AS lo, max(r) OVER w AS hi, list(r) OVER w AS rs
  FROM b WHERE r IS NOT NULL WINDOW w AS {_over(100)}),
d AS (SELECT *, s1 / n AS m, s2 / n - (s1 / n) * (s1 / n) AS var FROM c),
e AS (SELECT *, CASE WHEN var > 1e-12 THEN (s3 / n - 3 * m * s2 / n + 2 * m * m * m) / pow(var, 1.5) ELSE 0 END AS sk, CASE WHEN var > 1e-12 THEN (s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m) / (var * var) - 3 ELSE 0 END AS ku, CASE WHEN var > 1e-12 THEN ((c1 - m * c0) / n) / var ELSE 0 END AS ac,
  list_transform(rs, lambda x: least(9, floor((x - lo) / greatest(hi - lo, 1e-18) * 10)::INT)) AS bs FROM d)
SELECT symbol, trade_seq, n, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round(n / 6 * (sk * sk + ku * ku / 4), 4) AS jarque_bera,
  round(CASE WHEN hi > lo THEN list_sum(list_transform(range(0, 10), lambda k: CASE WHEN len(list_filter(bs, lambda x: x = k)) > 0 THEN -(len(list_filter(bs, lambda x: x = k)) / len(bs)) * log2(len(list_filter(bs, lambda x: x = k)) / len(bs)) ELSE 0 END)) ELSE 0 END, 4) AS entropy, round(ac, 4) AS autocorrelation FROM e""",
}
assert sum(map(len, NAMES.values())) == 64
