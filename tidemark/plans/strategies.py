"""Venues, routing, schedules, market conditions, positions and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, ratio, rows_back, up_to_now
from tidemark.operators.running import running
from tidemark.plans.trading import HISTORY, tqr_anomaly, with_mid
from tidemark.plans.trading import SQL as TRADING_SQL
from tidemark.sources.adapters import DAILY_SQL, TICKS_SQL, VENUES, daily_trades, quotes, table, trades, venues

MAX_COST_BPS, MAX_LATENCY_US, LEAST_SCORE, SHARE, MOST_VENUES = 10.0, 1000, 0.3, 0.4, 5

# The intraday volume curves of the schedules.
CURVE = (0.15, 0.10, 0.08, 0.07, 0.10, 0.10, 0.08, 0.07, 0.10, 0.15)
DAY_CURVE = (0.08, 0.06, 0.05, 0.04, 0.04, 0.05, 0.06, 0.07, 0.08, 0.08, 0.07, 0.06, 0.05, 0.05, 0.06, 0.08, 0.10, 0.12)

VENUES_SQL = f"""
vs AS (SELECT s_suppkey % {VENUES} AS venue, avg(s_suppkey % 7) AS a, avg(s_suppkey % 6) AS b, avg(s_suppkey % 5) AS c, avg(s_suppkey % 4) AS d, avg(s_suppkey % 3) AS e, avg(s_suppkey % 10) AS r, avg(s_suppkey % 8) AS w, sum(s_suppkey * 37 % 400)::BIGINT AS f, count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS h FROM supplier GROUP BY 1),
vn AS (SELECT venue, 'V' || venue AS venue_id, 1 + a AS avg_spread_bps, 0.3::DOUBLE + b / 10.0::DOUBLE AS fill_probability, 200 * (1 + c) AS avg_fill_size, d / 2.0::DOUBLE AS impact_bps, e / 10.0::DOUBLE AS fee_bps, 100 + f // n AS avg_latency_us, 2 * h >= n AS supports_hidden, r / 10.0::DOUBLE AS recent_fill_rate, w / 8.0::DOUBLE AS queue_position FROM vs)"""


def parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parent orders: whole quantities, urgency by priority."""
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), (F.floor(F.col("o_totalprice") / 10) + 1).cast("long").alias("quantity"), ((6 - urgency) / 5.0).alias("urgency"), F.col("o_custkey").alias("account"))


PARENTS_SQL = "pa AS (SELECT o_orderkey AS order_id, CAST(floor(o_totalprice / 10) AS BIGINT) + 1 AS quantity, (6 - substr(o_orderpriority, 1, 1)::INT) / 5.0::DOUBLE AS urgency, o_custkey AS account FROM orders)"


# -- venues -----------------------------------------------------------------------------------------------------------


def venue_analytics(t: DataFrame) -> DataFrame:
    """Fills by venue: share filled with a known side, mean size, cost against the venue's mean price, volume."""
    known = F.col("side") != "UNKNOWN"
    sums = t.groupBy("venue").agg(F.count("*").alias("sent"), F.count_if(known).alias("filled"), F.sum(F.when(known, F.col("quantity"))).alias("volume"), F.sum("price_e4").alias("p"), F.sum(F.when(known, F.col("price_e4") * F.col("quantity"))).alias("pq"))
    cost = (F.col("pq") / F.col("volume") / (F.col("p") / F.col("sent")) - 1) * 10000
    return sums.select("venue", "sent", "filled", "volume", F.round(F.col("filled") / F.col("sent"), 6).alias("fill_rate"), F.round(F.col("volume") / F.col("filled"), 3).alias("avg_fill_size"), F.round(cost, 3).alias("cost_bps"))


def venue_score(quantity: Column, learned: Column) -> Column:
    """History, fill probability, cost, latency and size match, raised for hidden size and a good place in the queue; three
    tenths of it are the recent fill rate. Within 0 and 1."""
    cost = 1 - (F.col("fee_bps") + F.col("impact_bps")) / MAX_COST_BPS
    late = F.when(F.col("avg_latency_us") < MAX_LATENCY_US, 0.1 * (1 - F.col("avg_latency_us") / float(MAX_LATENCY_US))).otherwise(0.0)
    size = 1 / (1 + F.abs(F.ln(quantity / F.col("avg_fill_size"))))
    base = 0.3 * learned + 0.25 * F.col("fill_probability") + 0.25 * F.greatest(F.lit(0.0), cost) + late + 0.1 * size
    whole = base * F.when((quantity > 10000) & F.col("supports_hidden"), 1.1).otherwise(1.0) + 0.05 * (1 - F.col("queue_position"))
    return clamp(0.7 * whole + 0.3 * F.col("recent_fill_rate"), 0.0, 1.0)


def venue_scores(v: DataFrame, sizes: tuple[int, ...] = (100, 1000, 20000)) -> DataFrame:
    rows = v.withColumn("quantity", F.explode(F.array(*[F.lit(q).cast("long") for q in sizes])))
    rows = rows.select("venue_id", "quantity", F.round(venue_score(F.col("quantity"), F.col("fill_probability")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("quantity").orderBy(F.desc("score"), "venue_id"))
    return rows.withColumn("rank", rank)


def dark_scores(t: DataFrame, quantity: int = 2000, least: float = 0.7) -> DataFrame:
    """Fill rate, cost, size match and latency of hidden trading by venue, weighted by the venue's own score and halved when
    rejects pile up; of the healthy venues over `least` the best three."""
    sums = t.groupBy("venue").agg(F.count_if("is_hidden").alias("filled"), F.count("*").alias("sent"), F.avg(F.when(F.col("is_hidden"), F.col("quantity"))).alias("size"), F.count_if(F.col("side") == "UNKNOWN").alias("rejects"))
    fill = F.col("filled") / F.col("sent")
    match = 1 - F.abs(F.col("size") - quantity) / (F.col("size") + quantity)
    late = F.greatest(F.lit(0.0), 1 - F.col("venue") * 0.1)
    cheap = F.greatest(F.lit(0.0), 1 - F.col("venue") / 10.0)
    score = (0.4 * fill + 0.3 * cheap + 0.2 * match + 0.1 * late) * (0.8 + 0.4 * (0.6 * fill + 0.4 * cheap)) * F.when(F.col("rejects") * 2 > F.col("sent"), 0.5).otherwise(1.0)
    rows = sums.select("venue", F.round(fill, 6).alias("fill_rate"), F.round(score, 6).alias("score"), (fill > 0.3).alias("healthy"))
    top = F.row_number().over(Window.orderBy(F.desc("score"), "venue"))  # one row for each venue
    return rows.withColumn("rank", top).withColumn("selected", (F.col("rank") <= 3) & F.col("healthy") & (F.col("score") > least))


def latency_pairs(v: DataFrame) -> DataFrame:
    """Pairs of venues of which one is at least 100 us faster: a theta join of a few rows."""
    f, s = v.alias("f"), v.alias("s")
    on = (F.col("f.venue") != F.col("s.venue")) & (F.col("s.avg_latency_us") - F.col("f.avg_latency_us") > 100)
    return f.join(s, on).select(F.col("f.venue_id").alias("fast"), F.col("s.venue_id").alias("slow"), (F.col("s.avg_latency_us") - F.col("f.avg_latency_us")).alias("advantage_us"))


def market_maker_quotes(v: DataFrame, t: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A bid and an ask of each symbol at each venue around the symbol's last price, skewed by its signed inventory."""
    last = t.groupBy("symbol").agg(F.max_by("price_e4", F.struct("ts_ns", "trade_seq")).alias("mid"), F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).when(F.col("side") == "SELL", -F.col("quantity")).otherwise(0)).alias("inventory"))
    half = F.col("avg_spread_bps") * F.col("mid") / 20000
    skew = -clamp(F.col("inventory") / float(limit), -1.0, 1.0) * half
    rows = last.crossJoin(F.broadcast(v))  # VENUES rows at most
    return rows.select("symbol", "venue_id", F.round(F.col("mid") - half + skew, 3).alias("bid"), F.round(F.col("mid") + half + skew, 3).alias("ask"))


def allocation(orders: DataFrame, v: DataFrame) -> DataFrame:
    """Greedy by score: at most 40 % to a venue and five venues, what is left to the best. Each order carries its ranked
    venues as one array and is folded by itself; no order meets another."""
    names = v.agg(F.collect_list(F.struct("venue_id", "avg_spread_bps", "fill_probability", "avg_fill_size", "impact_bps", "fee_bps", "avg_latency_us", "supports_hidden", "recent_fill_rate", "queue_position")).alias("vs"))
    rows = orders.crossJoin(F.broadcast(names)).select("order_id", "quantity", F.explode("vs").alias("x")).select("order_id", "quantity", "x.*")
    rows = rows.withColumn("score", F.round(venue_score(F.col("quantity"), F.col("fill_probability")), 6)).where(F.col("score") >= LEAST_SCORE)
    ranked = rows.groupBy("order_id", "quantity").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "venue_id"))).alias("r"))
    best = -F.get("r", F.lit(0))["s"]
    most = F.floor(F.col("quantity") * SHARE).cast("long")

    def step(state: Column, x: Column) -> Column:
        part = F.least(F.floor(state["left"] * (-x["s"]) / (best + 0.1)).cast("long"), most, state["left"])
        part = F.when(F.size(state["got"]) < MOST_VENUES, part).otherwise(F.lit(0).cast("long"))
        got = F.when(part > 0, F.concat(state["got"], F.array(F.struct(x["venue_id"].alias("venue_id"), part.alias("allocated"))))).otherwise(state["got"])
        return F.struct((state["left"] - part).alias("left"), got.alias("got"))

    start = F.struct(F.col("quantity").alias("left"), F.array().cast("array<struct<venue_id:string,allocated:bigint>>").alias("got"))
    done = ranked.select("order_id", F.get("r", F.lit(0))["venue_id"].alias("top"), F.aggregate("r", start, step).alias("z"))
    parts = done.select("order_id", F.explode(F.concat("z.got", F.array(F.struct(F.col("top").alias("venue_id"), F.col("z.left").alias("allocated"))))).alias("p")).where("p.allocated > 0")
    return parts.groupBy("order_id", "p.venue_id").agg(F.sum("p.allocated").alias("allocated"))


def venue_learning(t: DataFrame, rate: float = 0.1) -> DataFrame:
    """A score for each venue that moves by a tenth toward each day's outcome, from a half: a fold over its days. An
    outcome is the share filled, and what the fills cost against the day's mean price, ten basis points or more being 0."""
    known = F.col("side") != "UNKNOWN"
    days = t.groupBy("venue", "day").agg(F.count_if(known).alias("f"), F.count("*").alias("n"), F.sum("price_e4").alias("p"), F.sum(F.when(known, F.col("price_e4") * F.col("quantity"))).alias("pq"), F.sum(F.when(known, F.col("quantity"))).alias("q"))
    cost = F.coalesce(F.least(F.lit(10.0), F.abs(ratio(F.col("pq"), F.col("q")) / (F.col("p") / F.col("n")) - 1) * 10000), F.lit(0.0))
    days = days.select("venue", "day", (F.col("f") / F.col("n")).alias("fill"), (1 - F.round(cost, 6) / 10).alias("cheap"))
    seq = days.groupBy("venue").agg(F.sort_array(F.collect_list(F.struct("day", "fill", "cheap"))).alias("d"))
    return seq.select("venue", F.size("d").cast("long").alias("days"), F.round(F.aggregate("d", F.lit(0.5), lambda s, x: s * (1 - rate) + rate * (0.6 * x["fill"] + 0.4 * x["cheap"])), 6).alias("score"))


# -- schedules --------------------------------------------------------------------------------------------------------


def _buckets(orders: DataFrame, n: int) -> DataFrame:
    return orders.select("order_id", "quantity", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))


def _rest_to_last(rows: DataFrame, n: int) -> DataFrame:
    """What rounding left over goes to the last bucket."""
    given = F.sum("planned").over(Window.partitionBy("order_id"))
    return rows.withColumn("planned", F.col("planned") + F.when(F.col("bucket") == n - 1, F.greatest(F.lit(0), F.col("quantity") - given)).otherwise(0)).select("order_id", F.col("bucket").cast("long").alias("bucket"), "planned")


def schedule_vwap(orders: DataFrame, n: int = 10, normalised: bool = True) -> DataFrame:
    """By the volume curve, scaled so that its n values sum to one. Unless normalised, the curve's values are divided by the
    number of buckets instead, which leaves nine tenths of an order to the last bucket."""
    curve = F.element_at(F.array(*map(F.lit, CURVE)), F.col("bucket") % len(CURVE) + 1)
    whole = round(sum(CURVE[k % len(CURVE)] for k in range(n)), 9)
    return _rest_to_last(_buckets(orders, n).withColumn("planned", F.floor(F.round(F.col("quantity") * curve / (whole if normalised else n), 6)).cast("long")), n)


def schedule_twap(orders: DataFrame, n: int = 10) -> DataFrame:
    planned = F.expr(f"quantity div {n}") + F.when(F.col("bucket") < F.col("quantity") % n, 1).otherwise(0)
    return _buckets(orders, n).select("order_id", F.col("bucket").cast("long").alias("bucket"), planned.alias("planned"))


def schedule_shortfall(orders: DataFrame, n: int = 10, seconds: float = 600.0, kappa: float = 0.004) -> DataFrame:
    """Along the optimal trajectory X sinh(kappa (T - t)) / sinh(kappa T), in bucket middles."""
    held = lambda k: F.sinh(kappa * (seconds - k / n * seconds)) / F.sinh(F.lit(kappa * seconds))
    k = F.col("bucket")
    share = F.when(k == 0, 1 - held(k + 0.5)).otherwise(held(k - 0.5) - held(k + 0.5))
    return _rest_to_last(_buckets(orders, n).withColumn("planned", F.floor(F.round(F.col("quantity") * share, 6)).cast("long")), n)


def trajectory(risk: float = 1e-6, sigma: float = 0.02, eta: float = 1e-8, steps: int = 100):
    """Executed share at each step, with the characteristic time sqrt(risk sigma^2 / eta)."""
    tau = (risk * sigma * sigma / eta) ** 0.5

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.range(steps + 1).select(F.col("id").alias("step"))
        return rows.select("step", F.round(1 - F.sinh(F.lit(tau) * (1 - F.col("step") / float(steps))) / F.sinh(F.lit(tau)), 6).alias("executed"))

    return run, tau


# -- conditions, positions, risk --------------------------------------------------------------------------------------


def market_conditions(t: DataFrame, q: DataFrame, n: int = 20, spread_limit: float = 2.0, volatility_limit: float = 0.20, imbalance_limit: float = 0.3) -> DataFrame:
    """Annualised volatility of the last returns, spread, imbalance, whether conditions favour trading (all three below
    their limits), and the order type."""
    one = Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    rows = with_mid(t, q).withColumn("r", F.ln(ratio(F.col("price_e4"), F.lag("price_e4").over(one))))
    w = rows_back(n, "symbol", order=("ts_ns", "trade_seq"))
    vol = F.stddev_pop("r").over(w) * (252 * 6.5 * 60) ** 0.5
    buy = F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).over(w) / F.sum("quantity").over(w)
    spread = ratio((F.col("ask_e4") - F.col("bid_e4")) * 10000, F.expr("(bid_e4 + ask_e4) div 2"))
    rows = rows.select("symbol", "trade_seq", F.round(vol, 3).alias("volatility"), F.round(spread, 4).alias("spread_bps"), F.round(buy, 9).alias("imbalance"))
    good = (F.col("spread_bps") < spread_limit) & (F.col("volatility") < volatility_limit) & (F.abs("imbalance") < imbalance_limit)
    kind = F.when(F.abs("imbalance") > 0.5, "MARKET").when(F.col("spread_bps") < 2, "PEG").otherwise("LIMIT")
    return rows.withColumn("favourable", F.coalesce(good, F.lit(False))).withColumn("order_type", kind)


def slice_sizes(orders: DataFrame) -> DataFrame:
    """A tenth of the order by urgency between a hundred and ten thousand, shown whole or, if large, a tenth of it."""
    size = F.least(F.lit(10000), F.greatest(F.lit(100), F.floor(F.col("quantity") / 10 * (0.5 + F.col("urgency"))))).cast("long")
    rows = orders.withColumn("slice", size).withColumn("iceberg", F.col("quantity") > 10 * 1000)
    return rows.select("order_id", "slice", F.ceil(F.col("quantity") / F.col("slice")).cast("long").alias("slices"), "iceberg", F.when(F.col("iceberg"), F.floor(F.col("slice") / 10)).otherwise(F.col("slice")).cast("long").alias("shown"))


def positions(t: DataFrame) -> DataFrame:
    """Signed running position, cash and marked profit after each trade."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).when(F.col("side") == "SELL", -F.col("quantity")).otherwise(0)
    rows = t.select("symbol", "trade_seq", "ts_ns", "price_e4", signed.alias("q"))
    rows = running(rows, ["symbol"], ["ts_ns", "trade_seq"], {"position": F.col("q"), "cash_e4": -F.col("q") * F.col("price_e4")}, HISTORY)
    return rows.select("symbol", "trade_seq", "ts_ns", "position", "cash_e4", (F.col("cash_e4") + F.col("position") * F.col("price_e4")).alias("profit_e4"))


def value_at_risk(t: DataFrame, share: float = 0.05) -> DataFrame:
    """The index quantile of all returns, and the mean of those at or below it."""
    one = Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    r = t.select("symbol", "trade_seq", ratio(F.col("price_e4") - F.lag("price_e4").over(one), F.lag("price_e4").over(one)).alias("r")).where("r is not null")
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("r", "trade_seq"))
    n = F.count("*").over(Window.partitionBy("symbol"))
    rows = r.select("symbol", "r", k.alias("k"), (F.floor((n - 1) * share) + 1).alias("at"))
    return rows.where("k <= at").groupBy("symbol").agg(F.round(F.max("r"), 6).alias("var"), F.round(F.avg("r"), 6).alias("es"))


def drawdown(t: DataFrame) -> DataFrame:
    """The largest fall of profit from its highest point so far, and the mean-to-deviation ratio of its steps."""
    w = Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    rows = positions(t).select("symbol", "profit_e4", (F.max("profit_e4").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("profit_e4")).alias("fall"), (F.col("profit_e4") - F.lag("profit_e4").over(w)).cast("double").alias("step"))
    return rows.groupBy("symbol").agg(F.max("fall").alias("max_drawdown_e4"), F.round(F.avg("step") / F.stddev_pop("step"), 6).alias("sharpe"))


def reactions(found: DataFrame) -> DataFrame:
    """After each finding in a symbol the participation rises by a fifth, up to 30 %, and the urgency by a tenth, up to 1."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq"))
    rows = found.select("symbol", "trade_seq", n.alias("n"))
    return rows.select("symbol", "trade_seq", F.round(F.least(F.lit(0.3), 0.1 * F.pow(F.lit(1.2), F.col("n").cast("double"))), 6).alias("participation"), F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")), 6).alias("urgency"))


def gates(t: DataFrame, q: DataFrame, gap_ns: int = 60 * 60_000_000_000, spread: float = 5.0) -> DataFrame:
    """Whether a trade's moment would pass: long enough after the last one, and a spread that is not too wide."""
    rows = with_mid(t, q)
    since = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq"))
    wide = ratio((F.col("ask_e4") - F.col("bid_e4")) * 10000, F.expr("(bid_e4 + ask_e4) div 2"))
    return rows.select("symbol", "trade_seq", F.coalesce(since >= gap_ns, F.lit(True)).alias("spaced"), F.coalesce(wide <= spread, F.lit(False)).alias("tight"))


def rebalance(t: DataFrame) -> DataFrame:
    """Unfilled quantity (unknown sides) of each order goes to the venue that filled most of it; none filled: cancelled."""
    known = F.col("side") != "UNKNOWN"
    by_venue = t.groupBy(F.col("l_orderkey").alias("order_id"), "venue").agg(F.coalesce(F.sum(F.when(known, F.col("quantity"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(~known, F.col("quantity"))), F.lit(0)).alias("open"))
    sums = by_venue.groupBy("order_id").agg(F.sum("open").alias("open"), F.sum("filled").alias("filled"), F.max_by("venue", F.struct("filled", -F.col("venue"))).alias("best")).where("open > 0")
    return sums.select("order_id", "open", F.when(F.col("filled") > 0, F.col("best")).cast("long").alias("to_venue"), (F.col("filled") == 0).alias("cancelled"))


def risk_checks(orders: DataFrame, most: int = 20_000, total: int = 100_000) -> DataFrame:
    """Orders over the size limit, or that take the running total of their account's accepted sizes over its limit."""
    ok = F.when(F.col("quantity") <= most, F.col("quantity")).otherwise(0)
    run = F.sum(ok).over(up_to_now("account", order=("order_id",)))
    rows = orders.select("order_id", "quantity", F.when(F.col("quantity") > most, "ORDER_SIZE").when(run > total, "POSITION_LIMIT").otherwise("OK").alias("verdict"))
    reason = F.when(F.col("verdict") == "ORDER_SIZE", F.concat(F.lit("size "), F.col("quantity").cast("string"), F.lit(f" is over {most}"))).when(F.col("verdict") == "POSITION_LIMIT", F.lit(f"the account is over {total}"))
    return rows.select("order_id", "verdict", reason.alias("reason"))


RUN_TRAJECTORY, TAU = trajectory()
#: The limits of the registered query: ticks of minutes vary far more than those of a live feed.
CONDITIONS = {"spread_limit": 20.0, "volatility_limit": 500.0, "imbalance_limit": 0.3}
_RANKED = "row_number() OVER (PARTITION BY symbol ORDER BY r, trade_seq)"
_SCORE_SQL = f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.7::DOUBLE * ((0.3::DOUBLE * fill_probability + 0.25::DOUBLE * fill_probability + 0.25::DOUBLE * greatest(0, 1 - (fee_bps + impact_bps) / {MAX_COST_BPS}::DOUBLE)
  + CASE WHEN avg_latency_us < {MAX_LATENCY_US} THEN 0.1::DOUBLE * (1 - avg_latency_us / {MAX_LATENCY_US}::DOUBLE) ELSE 0 END + 0.1::DOUBLE * (1 / (1 + abs(ln(quantity / avg_fill_size))))) * CASE WHEN quantity > 10000 AND supports_hidden THEN 1.1::DOUBLE ELSE 1 END + 0.05::DOUBLE * (1 - queue_position)) + 0.3::DOUBLE * recent_fill_rate))"""


def _schedule_sql(planned: str) -> str:
    return f"""WITH {PARENTS_SQL}, b AS (SELECT *, unnest(range(0, 10)) AS bucket FROM pa), p AS (SELECT *, {planned} AS planned FROM b)
SELECT order_id, bucket, planned + CASE WHEN bucket = 9 THEN greatest(0, quantity - sum(planned) OVER (PARTITION BY order_id))::BIGINT ELSE 0 END AS planned FROM p"""


def _v(f):
    return lambda spark, sf: f(venues(spark, sf))


def _p(f):
    return lambda spark, sf: f(parents(spark, sf))


QUERIES = {
    "venue_analytics": lambda spark, sf: venue_analytics(daily_trades(spark, sf)),
    "venue_scores": _v(venue_scores),
    "dark_venue_scores": lambda spark, sf: dark_scores(daily_trades(spark, sf), least=0.3),
    "venue_learning": lambda spark, sf: venue_learning(daily_trades(spark, sf)),
    "latency_pairs": _v(latency_pairs),
    "market_maker_quotes": lambda spark, sf: market_maker_quotes(venues(spark, sf), trades(spark, sf)),
    "allocation_greedy": lambda spark, sf: allocation(parents(spark, sf), venues(spark, sf)),
    "schedule_vwap": _p(schedule_vwap),
    "schedule_twap": _p(schedule_twap),
    "schedule_is": _p(schedule_shortfall),
    "is_trajectory": RUN_TRAJECTORY,
    "slice_sizes": _p(slice_sizes),
    "market_conditions": lambda spark, sf: market_conditions(trades(spark, sf), quotes(spark, sf), **CONDITIONS),
    "reactions": lambda spark, sf: reactions(tqr_anomaly(trades(spark, sf), quotes(spark, sf)).join(trades(spark, sf).select("trade_seq", "ts_ns"), "trade_seq")),
    "execution_gates": lambda spark, sf: gates(trades(spark, sf), quotes(spark, sf)),
    "rebalance": lambda spark, sf: rebalance(daily_trades(spark, sf)),
    "risk_checks": _p(risk_checks),
    "positions": lambda spark, sf: positions(trades(spark, sf)).drop("ts_ns"),
    "value_at_risk": lambda spark, sf: value_at_risk(trades(spark, sf)),
    "drawdown": lambda spark, sf: drawdown(trades(spark, sf)),
}
SQL = {
    "venue_analytics": f"""WITH {DAILY_SQL}, s AS (SELECT venue, count(*) AS sent, count(*) FILTER (side <> 'UNKNOWN') AS filled, sum(quantity) FILTER (side <> 'UNKNOWN')::BIGINT AS volume, sum(price_e4)::DOUBLE AS p, sum(price_e4 * quantity) FILTER (side <> 'UNKNOWN')::DOUBLE AS pq FROM daily GROUP BY venue)
SELECT venue, sent, filled, volume, round(filled / sent, 6) AS fill_rate, round(volume / filled, 3) AS avg_fill_size, round((pq / volume / (p / sent) - 1) * 10000, 3) AS cost_bps FROM s""",
    "venue_scores": f"""WITH {VENUES_SQL}, x AS (SELECT *, unnest([100, 1000, 20000])::BIGINT AS quantity FROM vn), y AS (SELECT venue_id, quantity, round({_SCORE_SQL}, 6) AS score FROM x)
SELECT *, row_number() OVER (PARTITION BY quantity ORDER BY score DESC, venue_id) AS rank FROM y""",
    "dark_venue_scores": f"""WITH {DAILY_SQL}, s AS (SELECT venue, count(*) FILTER (is_hidden) AS filled, count(*) AS sent, avg(quantity) FILTER (is_hidden) AS size, count(*) FILTER (side = 'UNKNOWN') AS rejects FROM daily GROUP BY venue),
r AS (SELECT venue, round(filled / sent, 6) AS fill_rate, round((0.4::DOUBLE * (filled / sent) + 0.3::DOUBLE * greatest(0, 1 - venue / 10.0::DOUBLE) + 0.2::DOUBLE * (1 - abs(size - 2000) / (size + 2000)) + 0.1::DOUBLE * greatest(0, 1 - venue * 0.1::DOUBLE)) * (0.8::DOUBLE + 0.4::DOUBLE * (0.6::DOUBLE * (filled / sent) + 0.4::DOUBLE * greatest(0, 1 - venue / 10.0::DOUBLE))) * CASE WHEN rejects * 2 > sent THEN 0.5::DOUBLE ELSE 1 END, 6) AS score, filled / sent > 0.3 AS healthy FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, venue) AS rank FROM r) SELECT *, rank <= 3 AND healthy AND score > 0.3 AS selected FROM k""",
    "venue_learning": f"""WITH {DAILY_SQL}, e AS (SELECT venue, day, count(*) FILTER (side <> 'UNKNOWN') AS f, count(*) AS n, sum(price_e4)::DOUBLE AS p, sum(price_e4 * quantity) FILTER (side <> 'UNKNOWN')::DOUBLE AS pq, sum(quantity) FILTER (side <> 'UNKNOWN')::DOUBLE AS q FROM daily GROUP BY ALL),
d AS (SELECT venue, day, f / n AS fill, 1 - round(coalesce(least(10.0::DOUBLE, abs(pq / q / (p / n) - 1) * 10000), 0), 6) / 10 AS cheap FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY day DESC) - 1 AS k, count(*) OVER (PARTITION BY venue) AS n FROM d)
SELECT venue, any_value(n) AS days, round(0.5::DOUBLE * pow(0.9::DOUBLE, any_value(n)) + sum(0.1::DOUBLE * pow(0.9::DOUBLE, k) * (0.6::DOUBLE * fill + 0.4::DOUBLE * cheap)), 6) AS score FROM k GROUP BY venue""",
    "latency_pairs": f"WITH {VENUES_SQL} SELECT f.venue_id AS fast, s.venue_id AS slow, s.avg_latency_us - f.avg_latency_us AS advantage_us FROM vn f JOIN vn s ON f.venue <> s.venue AND s.avg_latency_us - f.avg_latency_us > 100",
    "market_maker_quotes": f"""WITH {VENUES_SQL}, {TICKS_SQL}, l AS (SELECT symbol, arg_max(price_e4, ts_ns) AS mid, sum(CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END)::DOUBLE AS inv FROM trades GROUP BY symbol),
x AS (SELECT symbol, venue_id, mid, avg_spread_bps * mid / 20000 AS half, -least(1.0::DOUBLE, greatest(-1.0::DOUBLE, inv / 1000000)) AS k FROM vn, l) SELECT symbol, venue_id, round(mid - half + k * half, 3) AS bid, round(mid + half + k * half, 3) AS ask FROM x""",
    "allocation_greedy": f"""WITH RECURSIVE {PARENTS_SQL}, {VENUES_SQL}, x AS (SELECT order_id, quantity, venue_id, round({_SCORE_SQL}, 6) AS score FROM pa, vn),
r AS (SELECT order_id, quantity, venue_id, score, row_number() OVER w AS k, max(score) OVER (PARTITION BY order_id) AS best, first_value(venue_id) OVER w AS top FROM x WHERE score >= {LEAST_SCORE} WINDOW w AS (PARTITION BY order_id ORDER BY score DESC, venue_id)),
s AS (SELECT order_id, 0::BIGINT AS k, quantity AS rest, 0 AS got, NULL::VARCHAR AS venue_id, 0::BIGINT AS part FROM (SELECT DISTINCT order_id, quantity FROM r)
  UNION ALL SELECT y.order_id, y.k, y.rest - y.p, y.got + CASE WHEN y.p > 0 THEN 1 ELSE 0 END, y.venue_id, y.p FROM (SELECT r.order_id, r.k, s.rest, s.got, r.venue_id, CASE WHEN s.got < {MOST_VENUES} THEN least(CAST(floor(s.rest * r.score / (r.best + 0.1::DOUBLE)) AS BIGINT), CAST(floor(r.quantity * {SHARE}::DOUBLE) AS BIGINT), s.rest) ELSE 0 END AS p
    FROM s JOIN r ON r.order_id = s.order_id AND r.k = s.k + 1) y),
e AS (SELECT order_id, venue_id, part FROM s WHERE part > 0 UNION ALL SELECT s.order_id, r.top, s.rest FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY k DESC) = 1) s JOIN r ON r.order_id = s.order_id AND r.k = 1 WHERE s.rest > 0)
SELECT order_id, venue_id, sum(part)::BIGINT AS allocated FROM e GROUP BY ALL""",
    "schedule_vwap": _schedule_sql(f"CAST(floor(round(quantity * [{', '.join(f'{c}::DOUBLE' for c in CURVE)}][bucket + 1], 6)) AS BIGINT)"),
    "schedule_twap": f"WITH {PARENTS_SQL}, b AS (SELECT *, unnest(range(0, 10)) AS bucket FROM pa) SELECT order_id, bucket, quantity // 10 + CASE WHEN bucket < quantity % 10 THEN 1 ELSE 0 END AS planned FROM b",
    "schedule_is": _schedule_sql(
        "CAST(floor(round(quantity * CASE WHEN bucket = 0 THEN 1 - sinh(0.004::DOUBLE * (600 - (bucket + 0.5::DOUBLE) / 10 * 600)) / sinh(2.4::DOUBLE) ELSE sinh(0.004::DOUBLE * (600 - (bucket - 0.5::DOUBLE) / 10 * 600)) / sinh(2.4::DOUBLE) - sinh(0.004::DOUBLE * (600 - (bucket + 0.5::DOUBLE) / 10 * 600)) / sinh(2.4::DOUBLE) END, 6)) AS BIGINT)"
    ),
    "is_trajectory": f"SELECT step, round(1 - sinh({TAU!r}::DOUBLE * (1 - step / 100)) / sinh({TAU!r}::DOUBLE), 6) AS executed FROM (SELECT unnest(range(0, 101)) AS step)",
    "slice_sizes": f"""WITH {PARENTS_SQL}, s AS (SELECT *, least(10000, greatest(100, CAST(floor(quantity / 10 * (0.5::DOUBLE + urgency)) AS BIGINT))) AS slice, quantity > 10000 AS iceberg FROM pa)
SELECT order_id, slice, CAST(ceil(quantity / slice) AS BIGINT) AS slices, iceberg, CASE WHEN iceberg THEN slice // 10 ELSE slice END AS shown FROM s""",
    "market_conditions": f"""WITH {TICKS_SQL}, m AS (SELECT t.*, q.bid_e4 AS b, q.ask_e4 AS a FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts_ns >= q.ts_ns),
r AS (SELECT *, ln(nullif(price_e4, 0)::DOUBLE / nullif(lag(price_e4) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq), 0)) AS r FROM m),
c AS (SELECT symbol, trade_seq, round(stddev_pop(r) OVER w * sqrt(252 * 6.5::DOUBLE * 60), 3) AS volatility, round((a - b) * 10000 / nullif((a + b) // 2, 0), 4) AS spread_bps, round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER w / sum(quantity) OVER w, 9) AS imbalance
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT *, coalesce(spread_bps < {CONDITIONS['spread_limit']} AND volatility < {CONDITIONS['volatility_limit']} AND abs(imbalance) < {CONDITIONS['imbalance_limit']}, false) AS favourable, CASE WHEN abs(imbalance) > 0.5 THEN 'MARKET' WHEN spread_bps < 2 THEN 'PEG' ELSE 'LIMIT' END AS order_type FROM c""",
    "reactions": f"""WITH {TICKS_SQL} SELECT symbol, trade_seq, round(least(0.3::DOUBLE, 0.1::DOUBLE * pow(1.2::DOUBLE, n)), 6) AS participation, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * n), 6) AS urgency
FROM (SELECT symbol, trade_seq, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq) AS n FROM ({TRADING_SQL['tqr_anomaly']}) a JOIN (SELECT trade_seq, ts_ns FROM trades) USING (trade_seq))""",
    "execution_gates": f"""WITH {TICKS_SQL}, m AS (SELECT t.*, q.bid_e4 AS b, q.ask_e4 AS a FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts_ns >= q.ts_ns)
SELECT symbol, trade_seq, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq) >= 3600000000000, true) AS spaced, coalesce((a - b) * 10000 / nullif((a + b) // 2, 0) <= 5, false) AS tight FROM m""",
    "rebalance": f"""WITH {DAILY_SQL}, v AS (SELECT l_orderkey AS order_id, venue, coalesce(sum(quantity) FILTER (side <> 'UNKNOWN'), 0)::BIGINT AS filled, coalesce(sum(quantity) FILTER (side = 'UNKNOWN'), 0)::BIGINT AS o FROM daily GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY filled DESC, venue) AS k FROM v)
SELECT order_id, sum(o)::BIGINT AS open, CASE WHEN sum(filled) > 0 THEN max(venue) FILTER (k = 1) END::BIGINT AS to_venue, sum(filled) = 0 AS cancelled FROM k GROUP BY order_id HAVING sum(o) > 0""",
    "risk_checks": f"""WITH {PARENTS_SQL}, v AS (SELECT order_id, quantity, CASE WHEN quantity > 20000 THEN 'ORDER_SIZE' WHEN sum(CASE WHEN quantity <= 20000 THEN quantity ELSE 0 END) OVER (PARTITION BY account ORDER BY order_id ROWS UNBOUNDED PRECEDING) > 100000 THEN 'POSITION_LIMIT' ELSE 'OK' END AS verdict FROM pa)
SELECT order_id, verdict, CASE verdict WHEN 'ORDER_SIZE' THEN 'size ' || quantity || ' is over 20000' WHEN 'POSITION_LIMIT' THEN 'the account is over 100000' END AS reason FROM v""",
    "positions": f"""WITH {TICKS_SQL}, s AS (SELECT *, CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END AS q FROM trades),
p AS (SELECT symbol, trade_seq, price_e4, sum(q) OVER w::BIGINT AS position, sum(-q * price_e4) OVER w::BIGINT AS cash_e4 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING)) SELECT symbol, trade_seq, position, cash_e4, cash_e4 + position * price_e4 AS profit_e4 FROM p""",
    "value_at_risk": f"""WITH {TICKS_SQL}, l AS (SELECT symbol, trade_seq, (price_e4 - lag(price_e4) OVER o)::DOUBLE / nullif(lag(price_e4) OVER o, 0) AS r FROM trades WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq)),
k AS (SELECT symbol, r, {_RANKED} AS k, floor((count(*) OVER (PARTITION BY symbol) - 1) * 0.05::DOUBLE) + 1 AS at_k FROM l WHERE r IS NOT NULL) SELECT symbol, round(max(r), 6) AS var, round(avg(r), 6) AS es FROM k WHERE k <= at_k GROUP BY symbol""",
    "drawdown": f"""WITH {TICKS_SQL}, s AS (SELECT *, CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END AS q FROM trades),
p AS (SELECT symbol, trade_seq, ts_ns, (sum(-q * price_e4) OVER w + sum(q) OVER w * price_e4)::BIGINT AS f FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT symbol, max(f) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING) - f AS fall, (f - lag(f) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq))::DOUBLE AS step FROM p)
SELECT symbol, max(fall) AS max_drawdown_e4, round(avg(step) / stddev_pop(step), 6) AS sharpe FROM d GROUP BY symbol""",
}
