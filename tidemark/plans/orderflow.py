"""Life of orders, execution quality, sizing under market conditions, and what is pushed to clients about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio, round_binary, rows_back
from tidemark.operators.asof import asof
from tidemark.operators.running import running
from tidemark.plans import liquidity
from tidemark.plans import trading as ticks
from tidemark.plans.strategies import CURVE, DAY_CURVE, PARENTS_SQL, VENUES_SQL, allocation, parents
from tidemark.plans.strategies import SQL as STRATEGIES_SQL
from tidemark.sources.adapters import DAILY_SQL, MINUTE, ORDER_EVENTS_SQL, TICKS_SQL, daily_trades, order_events, quotes, trades, venues

# -- life of orders ---------------------------------------------------------------------------------------------------


def order_states(e: DataFrame) -> DataFrame:
    """After each event of an order: its price, what remains of it, its state, its executions and whether they come faster
    than one a unit of time (a minute of ticks). A replacement sets price and quantity anew; executions and cancels take
    from what remains."""
    w = Window.partitionBy("order_id").orderBy("ts_ns", "event_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("kind").isin("NEW", "REPLACE")
    rows = e.withColumn("_life", F.sum(fresh.cast("int")).over(so_far)).withColumn("_n", F.sum((F.col("kind") == "EXEC").cast("int")).over(so_far))
    rows = rows.withColumn("_price", F.last(F.when(fresh, F.col("price_e4")), ignorenulls=True).over(so_far)).withColumn("_age", F.col("ts_ns") - F.min("ts_ns").over(so_far))
    life = Window.partitionBy("order_id", "_life").orderBy("ts_ns", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("remaining", F.sum(F.when(fresh, F.col("quantity")).otherwise(-F.col("quantity"))).over(life))
    state = F.when(F.col("remaining") > 0, "LIVE").when(F.col("kind") == "CANCEL", "CANCELLED").otherwise("FILLED")
    fast = F.coalesce(ratio(F.col("_n"), F.col("_age") / float(MINUTE)) > 1, F.lit(False))
    return rows.select("order_id", "event_no", "symbol", "kind", "ts_ns", F.col("_price").alias("price_e4"), "remaining", state.alias("state"), F.col("_n").alias("executions"), fast.alias("fast"), ((F.col("remaining") == 0) & fast).alias("potential_iceberg"))


def executions_of_orders(e: DataFrame) -> DataFrame:
    """Executions with the order that they are of; those of unknown orders are dropped."""
    new = e.where("kind = 'NEW'").select("order_id", "side", F.col("quantity").alias("ordered"), F.col("ts_ns").alias("entered"))
    return e.where("kind = 'EXEC'").drop("side").join(new, "order_id").select("order_id", "symbol", "venue", "side", "quantity", "ordered", (F.col("ts_ns") - F.col("entered")).alias("wait_ns"))


def queue_positions(e: DataFrame) -> DataFrame:
    """Mean of 1 - exp(-wait) by venue, the wait in units of time: 0 is the head of the queue."""
    sums = executions_of_orders(e).groupBy("venue").agg(F.count("*").alias("fills"), F.avg(1 - F.exp(-F.col("wait_ns") / float(MINUTE))).alias("p"))
    return sums.select("venue", "fills", F.round("p", 6).alias("position"))


def unfilled_orders(e: DataFrame, limit: int = MINUTE) -> DataFrame:
    """Orders by venue, and how many of them had no execution within the limit and count as cancelled."""
    own = e.groupBy("order_id", "venue").agg(F.min(F.when(F.col("kind") == "NEW", F.col("ts_ns"))).alias("a"), F.min(F.when(F.col("kind") == "EXEC", F.col("ts_ns"))).alias("b"))
    late = F.coalesce(F.col("b") - F.col("a") > limit, F.lit(True))
    return own.groupBy("venue").agg(F.count("*").alias("orders"), F.count_if(late).alias("cancelled"))


def execution_json(e: DataFrame) -> DataFrame:
    """Executions as they are pushed: the order's number, filled quantity and FILLED or PARTIAL."""
    rows = order_states(e).join(e.select("order_id", "event_no", "quantity"), ["order_id", "event_no"]).where("kind = 'EXEC'")
    status = F.when(F.col("remaining") == 0, "FILLED").otherwise("PARTIAL")
    return rows.select("order_id", "event_no", F.to_json(F.struct("order_id", "symbol", F.col("quantity").alias("filled"), "remaining", status.alias("status"))).alias("json"))


# -- execution quality ------------------------------------------------------------------------------------------------


def market_vwap(t: DataFrame) -> DataFrame:
    """Volume-weighted price of all trades so far, at each trade."""
    rows = t.select("symbol", "trade_seq", "ts_ns", "price_e4", "quantity")
    rows = running(rows, ["symbol"], ["ts_ns", "trade_seq"], {"pq": F.col("price_e4") * F.col("quantity"), "q": F.col("quantity")}, ticks.HISTORY)
    return rows.select("symbol", "trade_seq", F.round(F.col("pq").cast("double") / F.col("q"), 3).alias("vwap"))


def execution_performance(t: DataFrame) -> DataFrame:
    """Of each order's last fill in a symbol: shortfall against the order's first price and slippage against the symbol's
    volume-weighted price, in basis points; and the share of the order that was filled."""
    order = F.struct("day", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    known = F.col("side") != "UNKNOWN"
    vwap = t.groupBy("symbol").agg((F.sum(F.col("price_e4") * F.col("quantity")).cast("double") / F.sum("quantity")).alias("vwap"))
    sums = t.groupBy(F.col("l_orderkey").alias("order_id"), "symbol").agg(
        F.min_by("price_e4", order).alias("arrival_e4"), F.max_by(F.when(known, F.struct("price_e4", "side")), F.when(known, order)).alias("x"), F.coalesce(F.sum(F.when(known, F.col("quantity"))), F.lit(0)).alias("filled"), F.sum("quantity").alias("total")
    )
    rows = sums.where("x is not null").join(vwap, "symbol").select("order_id", "symbol", "arrival_e4", "x.*", "filled", "total", "vwap")
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    bps = lambda base: F.round(sign * ratio(F.col("price_e4") - F.col(base), F.col(base)) * 10000, 3)
    return rows.select("order_id", "symbol", "side", bps("arrival_e4").alias("shortfall_bps"), bps("vwap").alias("vwap_slippage_bps"), F.round(F.col("filled") / F.col("total"), 6).alias("fill_rate"))


def leakage_trend(t: DataFrame, least: int = 3) -> DataFrame:
    """Fills of an order that get dearer one after the other, `least` times running, against its first price."""
    order = ("day", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_orderkey", "side").orderBy(*order)
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    rows = t.where("side <> 'UNKNOWN'").withColumn("bps", F.round(sign * ratio(F.col("price_e4") - F.first("price_e4").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("price_e4").over(w.rowsBetween(Window.unboundedPreceding, 0))) * 10000, 3))
    rows = rows.withColumn("up", F.coalesce(F.col("bps") > F.lag("bps").over(w), F.lit(False)).cast("int")).withColumn("k", F.row_number().over(w))
    run = F.sum("up").over(w.rowsBetween(1 - least, 0))
    return rows.withColumn("run", run).groupBy(F.col("l_orderkey").alias("order_id"), "side").agg(F.count("*").alias("fills"), F.max("bps").alias("worst_bps"), F.max((F.col("run") == least).cast("int")).cast("boolean").alias("suspected"))


def late_executions(e: DataFrame, limit: int = MINUTE) -> DataFrame:
    """Executions with what is wrong with them: a long wait, a part of the order only."""
    late, part = F.col("wait_ns") > limit, F.col("quantity") < F.col("ordered")
    reasons = F.concat_ws(",", F.when(late, F.lit("high_latency")), F.when(part, F.lit("partial")))
    return executions_of_orders(e).select("order_id", (late | part).alias("anomalous"), reasons.alias("reasons"))


def fill_chain(t: DataFrame, p: DataFrame, v: DataFrame) -> DataFrame:
    """Fills with their parent order and their venue: by venue the orders, the quantity filled and what it cost in fees, and
    the mean urgency of the parents."""
    fills = t.where("side <> 'UNKNOWN'").groupBy(F.col("l_orderkey").alias("order_id"), "venue").agg(F.sum("quantity").alias("filled"))
    rows = fills.join(p.select("order_id", "urgency"), "order_id").join(F.broadcast(v.select(F.col("venue").cast("int").alias("venue"), "venue_id", "fee_bps")), "venue")  # VENUES rows at most
    sums = rows.groupBy("venue_id", "fee_bps").agg(F.count("*").alias("orders"), F.sum("filled").alias("filled"), F.avg("urgency").alias("u"))
    return sums.select("venue_id", "orders", "filled", F.round(F.col("filled") * F.col("fee_bps") / 10000, 4).alias("fees"), F.round("u", 6).alias("urgency"))


def routing_costs(p: DataFrame, v: DataFrame) -> DataFrame:
    """Allocated quantities by venue, with their fees in basis points of quantity."""
    sums = allocation(p, v).groupBy("venue_id").agg(F.count("*").alias("orders"), F.sum("allocated").alias("allocated"))
    return sums.join(F.broadcast(v.select("venue_id", "fee_bps")), "venue_id").select("venue_id", "orders", "allocated", F.round(F.col("allocated") * F.col("fee_bps") / 10000, 4).alias("fees"))


def pre_trade_mid(t: DataFrame, q: DataFrame) -> DataFrame:
    """The mid of the last quote strictly before each trade."""
    rows = asof(t.select("symbol", "trade_seq", "ts_ns"), q, ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], {"bid_e4": "bid_e4", "ask_e4": "ask_e4"}, ticks.DAY, equal=False)
    return rows.select("symbol", "trade_seq", F.expr("(bid_e4 + ask_e4) div 2").alias("mid"))


# -- sizing and gates -------------------------------------------------------------------------------------------------

#: Unit prices of risk and impact, participation, and seconds between orders.
RISK, IMPACT, PARTICIPATION, MOST, INTERVAL, HORIZON = 0.5, 0.1, 0.15, 0.30, 0.1, 600.0
LEAST_SIZE, LARGEST_SIZE = 100, 10_000


def conditions(t: DataFrame, q: DataFrame, n: int = 20) -> DataFrame:
    """At each trade: volatility of the last returns, spread, depth imbalance of the quote, traded volume and span of the
    last n trades (in units of time)."""
    w, one = rows_back(n, "symbol", order=("ts_ns", "trade_seq")), Window.partitionBy("symbol").orderBy("ts_ns", "trade_seq")
    take = {c: c for c in ("bid_e4", "ask_e4", "bid_size", "ask_size")}
    rows = asof(t, q, ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], take, ticks.DAY)
    rows = rows.withColumn("r", F.ln(ratio(F.col("price_e4"), F.lag("price_e4").over(one))))
    return rows.select(
        "symbol", "trade_seq", "ts_ns", "side", round_binary(F.stddev_pop("r").over(w), 9).alias("volatility"), round_binary(ratio((F.col("ask_e4") - F.col("bid_e4")) * 10000, F.expr("(bid_e4 + ask_e4) div 2")), 4).alias("spread_bps"),
        round_binary(ratio(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size")), 6).alias("depth"), F.sum("quantity").over(w).alias("volume"), F.count("*").over(w).alias("n"),
        round_binary((F.max("ts_ns").over(w) - F.min("ts_ns").over(w)) / float(MINUTE), 6).alias("span"),
    )


def slice_quantities(t: DataFrame, q: DataFrame, total: int = 50_000) -> DataFrame:
    """What the next order of an execution of `total` that starts at a trade would hold, by each algorithm: along the
    volume curve and adjusted for conditions, by the optimal trading rate, by participation in the volume, and adaptively.
    All are held between LEAST_SIZE and LARGEST_SIZE."""
    c = conditions(t, q)
    sell, buy = F.col("side") != "BUY", F.col("side") == "BUY"
    adjust = F.when(F.col("spread_bps") > 3, 0.8).when(F.col("spread_bps") < 1, 1.2).otherwise(1.0) * F.when(F.col("volatility") > 0.3, 0.7).otherwise(1.0)
    adjust = adjust * F.when((buy & (F.col("depth") > 0.3)) | (sell & (F.col("depth") < -0.3)), 0.9).otherwise(1.0)
    vwap = F.floor(round_binary(F.lit(total * CURVE[0]) * adjust, 6))
    kappa = F.greatest(F.col("volatility"), F.lit(1e-6)) * (RISK / IMPACT) ** 0.5
    shortfall = F.floor(round_binary(total * kappa / F.sinh(F.least(kappa * HORIZON, F.lit(500.0))) * INTERVAL, 6))
    pov = F.floor(round_binary(F.coalesce(ratio(F.col("volume"), F.col("span")), F.lit(0.0)) * PARTICIPATION * INTERVAL, 6))
    chance = F.coalesce(F.col("spread_bps") > 4, F.lit(False)) | F.coalesce((buy & (F.col("depth") < -0.5)) | (sell & (F.col("depth") > 0.5)), F.lit(False)) | F.coalesce(F.col("volatility") < 0.1, F.lit(False))
    adaptive = F.when(chance, F.least(F.floor(shortfall * 1.5), F.floor(round_binary(F.col("volume") * MOST, 6)))).otherwise(shortfall)
    held = lambda x: F.least(F.lit(LARGEST_SIZE), F.greatest(F.lit(LEAST_SIZE), F.coalesce(x, F.lit(0)))).cast("long")
    return c.select("symbol", "trade_seq", held(vwap).alias("vwap"), held(shortfall).alias("shortfall"), held(pov).alias("pov"), chance.alias("opportunity"), held(adaptive).alias("adaptive"))


def dark_gate(t: DataFrame, q: DataFrame, urgency: float = 0.5, least_spread: float = 1.0, busy: float = 100.0, n: int = 20) -> DataFrame:
    """Whether an order at a trade's moment may go to a dark venue: not in a tight market, and in a busy one (trades in a
    unit of time) only if it is not urgent."""
    c = conditions(t, q, n)
    rate = F.when(F.col("n") > 10, ratio(F.col("n"), F.col("span")))
    ok = F.coalesce(F.col("spread_bps") >= least_spread, F.lit(False)) & (~F.coalesce(rate > busy, F.lit(False)) | F.lit(urgency < 0.7))
    return c.select("symbol", "trade_seq", ok.alias("use_dark"))


def slice_children(p: DataFrame, n: int = 10) -> DataFrame:
    """Equal slices, what is left over to the first; sizes vary by a tenth and times by 50 ms, by hashes of order and slice."""
    rows = p.select("order_id", "quantity", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    digits = F.md5(F.concat_ws("|", F.col("order_id").cast("string"), F.col("slice").cast("string")))
    share = lambda at: F.conv(F.substring(digits, at, 6), 16, 10).cast("long")
    equal = F.expr(f"quantity div {n}") + F.when(F.col("slice") == 0, F.col("quantity") % n).otherwise(0)
    size = F.greatest(F.lit(1), F.floor(F.round(equal * (0.9 + 0.2 * share(1) / 16777216), 6)).cast("long"))
    return rows.select("order_id", F.col("slice").cast("long").alias("slice"), equal.alias("equal"), size.alias("size"), (share(7) % 101 - 50).alias("shift_ms"))


def schedule_day(p: DataFrame) -> DataFrame:
    """Planned sizes along the curve of a day's eighteen parts; what rounding leaves goes to the last."""
    n, whole = len(DAY_CURVE), round(sum(DAY_CURVE), 9)
    rows = p.select("order_id", "quantity", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    rows = rows.withColumn("planned", F.floor(F.round(F.col("quantity") * F.element_at(F.array(*map(F.lit, DAY_CURVE)), F.col("bucket") + 1) / whole, 6)).cast("long"))
    given = F.sum("planned").over(Window.partitionBy("order_id"))
    return rows.select("order_id", F.col("bucket").cast("long").alias("bucket"), (F.col("planned") + F.when(F.col("bucket") == n - 1, F.col("quantity") - given).otherwise(0)).alias("planned"))


def schedule_pov(p: DataFrame, n: int = 10) -> DataFrame:
    """Participation follows the market's volume, so nothing is planned ahead."""
    return p.select("order_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"), F.lit(0).cast("long").alias("planned"))


#: The dark aggregator's and the router's answers are constants until there is a source for them; they claim nothing.
SNAPSHOT, ROUTES = (50_000, 48_000, 2.0), (("VENUE1", 0.4), ("VENUE2", 0.3), ("VENUE3", 0.3))


def routing_stub(p: DataFrame) -> DataFrame:
    rows = p.select("order_id", "quantity", F.explode(F.array(*[F.struct(F.lit(v).alias("venue_id"), F.lit(s).alias("share")) for v, s in ROUTES])).alias("r"))
    return rows.select("order_id", "r.venue_id", F.floor(F.round(F.col("quantity") * F.col("r.share"), 6)).cast("long").alias("allocated"), F.lit(1.5).alias("expected_cost_bps"))


def aggregated_liquidity(t: DataFrame) -> DataFrame:
    bid, ask, spread = SNAPSHOT
    return t.select("symbol").distinct().select("symbol", F.lit(bid).cast("long").alias("bid_liquidity"), F.lit(ask).cast("long").alias("ask_liquidity"), F.lit(spread).alias("spread_bps"))


# -- symbols, phases, frames ------------------------------------------------------------------------------------------


def active_symbols(t: DataFrame, q: DataFrame) -> DataFrame:
    """Symbols seen, with their messages and their last one's time."""
    both = t.select("symbol", "ts_ns").unionByName(q.select("symbol", "ts_ns"))
    return both.groupBy("symbol").agg(F.count("*").alias("messages"), F.max("ts_ns").alias("last_ts"))


def after_reset(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """What is left of a history after each symbol's last reset (symbol, reset_ns); detectors start anew on it."""
    last = resets.groupBy("symbol").agg(F.max("reset_ns").alias("_reset"))
    return rows.join(last, "symbol", "left").where("_reset is null or ts_ns > _reset").drop("_reset")


def market_phase(t: DataFrame) -> DataFrame:
    """Phase of the day: before 09:30, the first and the last half hour of trading, between them, and after 16:00."""
    s = F.expr("ts_ns div 1000000000 % 86400")
    phase = F.when(s < 34_200, "PRE_OPEN").when(s < 36_000, "OPENING").when(s < 55_800, "CONTINUOUS").when(s < 57_600, "CLOSING").otherwise("CLOSED")
    return t.groupBy("symbol", phase.alias("phase")).agg(F.count("*").alias("trades"), F.sum("quantity").alias("volume"))


def heatmap_anomalies(t: DataFrame, found: DataFrame, width: int = 12 * ticks.HOUR, rows: int = 60) -> DataFrame:
    """The heatmap's cells with the number of findings in their time bucket: a finding marks all price cells of its time."""
    as_of = t.groupBy("symbol").agg(F.max("ts_ns").alias("as_of"))
    counts = found.join(as_of, "symbol").groupBy("symbol", F.floor((F.col("as_of") - F.col("ts_ns")) / width).cast("long").alias("age")).agg(F.count("*").alias("anomalies"))
    cells = liquidity.heatmap_cells(t, rows=rows, width=width).select("symbol", "age", "cell")
    return cells.join(counts, ["symbol", "age"], "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))


def _le(value: Column, n: int) -> Column:
    """n bytes of a number as hex, lowest byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])


def binary_frame(kind: int, sequence: Column, ts_ns: Column, payload: Column) -> Column:
    """Type (1 byte), sequence (4), time (8), length (4), payload; numbers have their lowest byte first."""
    raw = F.encode(payload, "UTF-8")
    return F.unhex(F.concat(F.lit(f"{kind:02X}"), _le(sequence, 4), _le(ts_ns, 8), _le(F.octet_length(raw), 4), F.hex(raw)))


def market_frames(t: DataFrame) -> DataFrame:
    """Trades as binary frames, shown as hex."""
    return t.select("trade_seq", F.hex(binary_frame(2, F.col("trade_seq"), F.col("ts_ns"), F.concat_ws(",", F.col("symbol").cast("string"), F.col("price_e4").cast("string"), F.col("quantity").cast("string")))).alias("frame"))


def _e(f):
    return lambda spark, sf: f(order_events(spark, sf))


def _t(f):
    return lambda spark, sf: f(trades(spark, sf))


def _tq(f):
    return lambda spark, sf: f(trades(spark, sf), quotes(spark, sf))


def _p(f):
    return lambda spark, sf: f(parents(spark, sf))


def _heat(spark: SparkSession, sf: str) -> DataFrame:
    t, q = trades(spark, sf), quotes(spark, sf)
    return heatmap_anomalies(t, ticks.tqr_anomaly(t, q).join(t.select("trade_seq", "ts_ns"), "trade_seq"))


QUERIES = {
    "order_states": _e(order_states),
    "order_executions": _e(executions_of_orders),
    "queue_positions": _e(queue_positions),
    "unfilled_orders": _e(unfilled_orders),
    "execution_json": _e(execution_json),
    "market_vwap": _t(market_vwap),
    "execution_performance": lambda spark, sf: execution_performance(daily_trades(spark, sf)),
    "leakage_trend": lambda spark, sf: leakage_trend(daily_trades(spark, sf)),
    "late_executions": _e(late_executions),
    "fill_chain": lambda spark, sf: fill_chain(daily_trades(spark, sf), parents(spark, sf), venues(spark, sf)),
    "routing_costs": lambda spark, sf: routing_costs(parents(spark, sf), venues(spark, sf)),
    "pre_trade_mid": _tq(pre_trade_mid),
    "slice_quantities": _tq(slice_quantities),
    "dark_gate": _tq(lambda t, q: dark_gate(t, q, urgency=0.8, least_spread=5.0, busy=0.05)),
    "slice_children": _p(slice_children),
    "schedule_day": _p(schedule_day),
    "schedule_pov": _p(schedule_pov),
    "routing_stub": _p(routing_stub),
    "aggregated_liquidity": _t(aggregated_liquidity),
    "active_symbols": _tq(active_symbols),
    "market_phase": _t(market_phase),
    "heatmap_anomalies": _heat,
    "market_frames": _t(market_frames),
}

_STATES_SQL = f"""{TICKS_SQL}, {ORDER_EVENTS_SQL},
o1 AS (SELECT *, sum(CASE WHEN kind IN ('NEW', 'REPLACE') THEN 1 ELSE 0 END) OVER w AS life, sum(CASE WHEN kind = 'EXEC' THEN 1 ELSE 0 END) OVER w AS n, last_value(CASE WHEN kind IN ('NEW', 'REPLACE') THEN price_e4 END IGNORE NULLS) OVER w AS price, ts_ns - min(ts_ns) OVER w AS age
  FROM oe WINDOW w AS (PARTITION BY order_id ORDER BY ts_ns, event_no ROWS UNBOUNDED PRECEDING)),
o2 AS (SELECT *, sum(CASE WHEN kind IN ('NEW', 'REPLACE') THEN quantity ELSE -quantity END) OVER (PARTITION BY order_id, life ORDER BY ts_ns, event_no ROWS UNBOUNDED PRECEDING)::BIGINT AS remaining, coalesce(n / nullif(age / {float(MINUTE)}, 0) > 1, false) AS fast FROM o1),
os AS (SELECT order_id, event_no, symbol, kind, ts_ns, price AS price_e4, remaining, CASE WHEN remaining > 0 THEN 'LIVE' WHEN kind = 'CANCEL' THEN 'CANCELLED' ELSE 'FILLED' END AS state, n::BIGINT AS executions, fast, remaining = 0 AND fast AS potential_iceberg FROM o2),
ox AS (SELECT x.order_id, x.symbol, x.venue, n.side, x.quantity, n.quantity AS ordered, x.ts_ns - n.ts_ns AS wait_ns FROM oe x JOIN oe n ON x.order_id = n.order_id AND n.kind = 'NEW' WHERE x.kind = 'EXEC')"""

_CONDITIONS_SQL = f"""{TICKS_SQL},
cm AS (SELECT t.*, q.bid_e4, q.ask_e4, q.bid_size, q.ask_size FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts_ns >= q.ts_ns),
cr AS (SELECT *, ln(nullif(price_e4, 0)::DOUBLE / nullif(lag(price_e4) OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq), 0)) AS r FROM cm),
cc AS (SELECT symbol, trade_seq, side, round(stddev_pop(r) OVER w, 9) AS volatility, round((ask_e4 - bid_e4) * 10000 / nullif((bid_e4 + ask_e4) // 2, 0), 4) AS spread_bps, round((bid_size - ask_size) / nullif(bid_size + ask_size, 0), 6) AS depth,
  sum(quantity) OVER w AS volume, count(*) OVER w AS n, round((max(ts_ns) OVER w - min(ts_ns) OVER w) / {float(MINUTE)}, 6) AS span FROM cr WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _held_sql(x: str) -> str:
    return f"CAST(least({LARGEST_SIZE}, greatest({LEAST_SIZE}, coalesce({x}, 0))) AS BIGINT)"


_LE = lambda v, n: " || ".join(f"printf('%02X', ({v} >> {8 * i}) & 255)" for i in range(n))
_DAY_SUM = round(sum(DAY_CURVE), 9)
SQL = {
    "order_states": f"WITH {_STATES_SQL} SELECT * FROM os",
    "order_executions": f"WITH {_STATES_SQL} SELECT * FROM ox",
    "queue_positions": f"WITH {_STATES_SQL} SELECT venue, count(*) AS fills, round(avg(1 - exp(-wait_ns / {float(MINUTE)})), 6) AS position FROM ox GROUP BY venue",
    "unfilled_orders": f"""WITH {_STATES_SQL}, u AS (SELECT order_id, venue, min(ts_ns) FILTER (kind = 'NEW') AS a, min(ts_ns) FILTER (kind = 'EXEC') AS b FROM oe GROUP BY ALL)
SELECT venue, count(*) AS orders, count(*) FILTER (coalesce(b - a > {MINUTE}, true)) AS cancelled FROM u GROUP BY venue""",
    "execution_json": f"""WITH {_STATES_SQL} SELECT order_id, event_no, '{{"order_id":' || order_id || ',"symbol":' || symbol || ',"filled":' || quantity || ',"remaining":' || remaining || ',"status":"' || CASE WHEN remaining = 0 THEN 'FILLED' ELSE 'PARTIAL' END || '"}}' AS json
FROM os JOIN (SELECT order_id, event_no, quantity FROM oe) USING (order_id, event_no) WHERE kind = 'EXEC'""",
    "market_vwap": f"WITH {TICKS_SQL} SELECT symbol, trade_seq, round(sum(price_e4 * quantity) OVER w::DOUBLE / (sum(quantity) OVER w)::DOUBLE, 3) AS vwap FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING)",
    "execution_performance": f"""WITH {DAILY_SQL}, v AS (SELECT symbol, sum(price_e4 * quantity)::DOUBLE / sum(quantity)::DOUBLE AS vwap FROM daily GROUP BY symbol),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, symbol ORDER BY day, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, row_number() OVER (PARTITION BY l_orderkey, symbol, side <> 'UNKNOWN' ORDER BY day DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS b FROM daily),
s AS (SELECT l_orderkey AS order_id, symbol, max(price_e4) FILTER (k = 1) AS arrival, max(price_e4) FILTER (b = 1 AND side <> 'UNKNOWN') AS price, max(side) FILTER (b = 1 AND side <> 'UNKNOWN') AS side, coalesce(sum(quantity) FILTER (side <> 'UNKNOWN'), 0) AS filled, sum(quantity) AS total FROM k GROUP BY ALL)
SELECT order_id, symbol, side, round(CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((price - arrival) / nullif(arrival, 0)) * 10000, 3) AS shortfall_bps, round(CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((price - vwap) / nullif(vwap, 0)) * 10000, 3) AS vwap_slippage_bps, round(filled / total, 6) AS fill_rate
FROM s JOIN v USING (symbol) WHERE side IS NOT NULL""",
    "leakage_trend": f"""WITH {DAILY_SQL}, b AS (SELECT *, round(CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((price_e4 - first_value(price_e4) OVER w) / nullif(first_value(price_e4) OVER w, 0)) * 10000, 3) AS bps FROM daily WHERE side <> 'UNKNOWN'
  WINDOW w AS (PARTITION BY l_orderkey, side ORDER BY {', '.join(liquidity.DAY_ORDER[:1] + liquidity.DAY_ORDER[2:])} ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, CASE WHEN bps > lag(bps) OVER o THEN 1 ELSE 0 END AS up FROM b WINDOW o AS (PARTITION BY l_orderkey, side ORDER BY {', '.join(liquidity.DAY_ORDER[:1] + liquidity.DAY_ORDER[2:])})),
r AS (SELECT *, sum(up) OVER (PARTITION BY l_orderkey, side ORDER BY {', '.join(liquidity.DAY_ORDER[:1] + liquidity.DAY_ORDER[2:])} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM u)
SELECT l_orderkey AS order_id, side, count(*) AS fills, max(bps) AS worst_bps, bool_or(run = 3) AS suspected FROM r GROUP BY ALL""",
    "late_executions": f"WITH {_STATES_SQL} SELECT order_id, wait_ns > {MINUTE} OR quantity < ordered AS anomalous, concat_ws(',', CASE WHEN wait_ns > {MINUTE} THEN 'high_latency' END, CASE WHEN quantity < ordered THEN 'partial' END) AS reasons FROM ox",
    "fill_chain": f"""WITH {DAILY_SQL}, {PARENTS_SQL}, {VENUES_SQL}, f AS (SELECT l_orderkey AS order_id, venue, sum(quantity)::BIGINT AS filled FROM daily WHERE side <> 'UNKNOWN' GROUP BY ALL)
SELECT venue_id, count(*) AS orders, sum(filled)::BIGINT AS filled, round(sum(filled) * any_value(fee_bps) / 10000, 4) AS fees, round(avg(urgency), 6) AS urgency FROM f JOIN pa USING (order_id) JOIN vn USING (venue) GROUP BY venue_id""",
    "routing_costs": f"WITH {VENUES_SQL}, a AS ({STRATEGIES_SQL['allocation_greedy']}) SELECT venue_id, count(*) AS orders, sum(allocated)::BIGINT AS allocated, round(sum(allocated) * any_value(fee_bps) / 10000, 4) AS fees FROM a JOIN vn USING (venue_id) GROUP BY venue_id",
    "pre_trade_mid": f"WITH {TICKS_SQL} SELECT t.symbol, trade_seq, (bid_e4 + ask_e4) // 2 AS mid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts_ns > q.ts_ns",
    "slice_quantities": f"""WITH {_CONDITIONS_SQL},
a AS (SELECT *, CASE WHEN spread_bps > 3 THEN 0.8::DOUBLE WHEN spread_bps < 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN volatility > 0.3 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN (side = 'BUY' AND depth > 0.3) OR (side <> 'BUY' AND depth < -0.3) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS adj,
  greatest(volatility, 1e-6) * {(RISK / IMPACT) ** 0.5!r}::DOUBLE AS kappa FROM cc),
b AS (SELECT *, floor(round({50_000 * CURVE[0]!r}::DOUBLE * adj, 6)) AS v, floor(round(50000 * kappa / sinh(least(kappa * {HORIZON}::DOUBLE, 500.0::DOUBLE)) * {INTERVAL}::DOUBLE, 6)) AS f, floor(round(coalesce(volume / nullif(span, 0), 0) * {PARTICIPATION}::DOUBLE * {INTERVAL}::DOUBLE, 6)) AS p,
  coalesce(spread_bps > 4, false) OR coalesce((side = 'BUY' AND depth < -0.5) OR (side <> 'BUY' AND depth > 0.5), false) OR coalesce(volatility < 0.1, false) AS opportunity FROM a)
SELECT symbol, trade_seq, {_held_sql('v')} AS vwap, {_held_sql('f')} AS shortfall, {_held_sql('p')} AS pov, opportunity, {_held_sql(f'CASE WHEN opportunity THEN least(floor(f * 1.5), floor(round(volume * {MOST}::DOUBLE, 6))) ELSE f END')} AS adaptive FROM b""",
    "dark_gate": f"WITH {_CONDITIONS_SQL} SELECT symbol, trade_seq, coalesce(spread_bps >= 5, false) AND NOT coalesce(CASE WHEN n > 10 THEN n / nullif(span, 0) END > 0.05, false) AS use_dark FROM cc",
    "slice_children": f"""WITH {PARENTS_SQL}, b AS (SELECT order_id, quantity, unnest(range(0, 10)) AS slice FROM pa), h AS (SELECT *, md5(order_id || '|' || slice) AS d, quantity // 10 + CASE WHEN slice = 0 THEN quantity % 10 ELSE 0 END AS equal FROM b)
SELECT order_id, slice, equal, greatest(1, CAST(floor(round(equal * (0.9::DOUBLE + 0.2::DOUBLE * ('0x' || substr(d, 1, 6))::BIGINT / 16777216), 6)) AS BIGINT)) AS size, ('0x' || substr(d, 7, 6))::BIGINT % 101 - 50 AS shift_ms FROM h""",
    "schedule_day": f"""WITH {PARENTS_SQL}, b AS (SELECT order_id, quantity, unnest(range(0, {len(DAY_CURVE)})) AS bucket FROM pa), p AS (SELECT *, CAST(floor(round(quantity * [{', '.join(f'{c}::DOUBLE' for c in DAY_CURVE)}][bucket + 1] / {_DAY_SUM}::DOUBLE, 6)) AS BIGINT) AS planned FROM b)
SELECT order_id, bucket, planned + CASE WHEN bucket = {len(DAY_CURVE) - 1} THEN (quantity - sum(planned) OVER (PARTITION BY order_id))::BIGINT ELSE 0 END AS planned FROM p""",
    "schedule_pov": f"WITH {PARENTS_SQL} SELECT order_id, unnest(range(0, 10)) AS bucket, 0::BIGINT AS planned FROM pa",
    "routing_stub": f"WITH {PARENTS_SQL}, r AS (SELECT unnest([{', '.join(repr(v) for v, _ in ROUTES)}]) AS venue_id, unnest([{', '.join(f'{s}::DOUBLE' for _, s in ROUTES)}]) AS share) SELECT order_id, venue_id, CAST(floor(round(quantity * share, 6)) AS BIGINT) AS allocated, 1.5::DOUBLE AS expected_cost_bps FROM pa, r",
    "aggregated_liquidity": f"WITH {TICKS_SQL} SELECT DISTINCT symbol, {SNAPSHOT[0]}::BIGINT AS bid_liquidity, {SNAPSHOT[1]}::BIGINT AS ask_liquidity, {SNAPSHOT[2]}::DOUBLE AS spread_bps FROM trades",
    "active_symbols": f"WITH {TICKS_SQL} SELECT symbol, count(*) AS messages, max(ts_ns) AS last_ts FROM (SELECT symbol, ts_ns FROM trades UNION ALL SELECT symbol, ts_ns FROM quotes) GROUP BY symbol",
    "market_phase": f"""WITH {TICKS_SQL}, s AS (SELECT symbol, quantity, ts_ns // 1000000000 % 86400 AS s FROM trades)
SELECT symbol, CASE WHEN s < 34200 THEN 'PRE_OPEN' WHEN s < 36000 THEN 'OPENING' WHEN s < 55800 THEN 'CONTINUOUS' WHEN s < 57600 THEN 'CLOSING' ELSE 'CLOSED' END AS phase, count(*) AS trades, sum(quantity)::BIGINT AS volume FROM s GROUP BY ALL""",
    "heatmap_anomalies": f"""WITH {TICKS_SQL}, a AS (SELECT symbol, max(ts_ns) AS as_of FROM trades GROUP BY symbol), f AS (SELECT symbol, (as_of - ts_ns) // {12 * ticks.HOUR} AS age, count(*) AS anomalies FROM ({ticks.SQL['tqr_anomaly']}) JOIN (SELECT trade_seq, ts_ns FROM trades) USING (trade_seq) JOIN a USING (symbol) GROUP BY ALL)
SELECT symbol, age, cell, coalesce(anomalies, 0) AS anomalies FROM ({liquidity.SQL['heatmap_cells']}) LEFT JOIN f USING (symbol, age)""",
    "market_frames": f"""WITH {TICKS_SQL}, p AS (SELECT trade_seq, ts_ns, symbol || ',' || price_e4 || ',' || quantity AS x FROM trades) SELECT trade_seq, '02' || {_LE('trade_seq', 4)} || {_LE('ts_ns', 8)} || {_LE('length(x)', 4)} || hex(encode(x)) AS frame FROM p""",
}
