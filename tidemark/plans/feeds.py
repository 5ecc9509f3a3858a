"""Protocol feeds end to end, the anomaly table of all detectors, and its JSON."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import liquidity, models, trading
from tidemark.plans.config import Detectors
from tidemark.sources import binary, fix
from tidemark.sources.adapters import DAILY_SQL, HOUR, MINUTE, TICKS_SQL, books, daily_trades, events, orders, quotes, trades


def fix_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = fix.write_events(events(spark, sf))
    # all messages stay, heartbeats too: a filter would be pushed below the decoding and repeat it
    return fix.decode(rows).select("kind", "order_id_str", "symbol", "side", "price_e4", "quantity", "bid_e4", "ask_e4", "bid_size", "ask_size", "tod_ns")


def fix_checksums(spark: SparkSession, sf: str) -> DataFrame:
    rows = fix.write_events(events(spark, sf))
    return rows.select("seq", fix.checksum_ok(F.col("value")).alias("ok"))


def itch_parse(spark: SparkSession, sf: str) -> DataFrame:
    return binary.itch_trades(binary.write_itch(events(spark, sf)))


def itch_order_parse(spark: SparkSession, sf: str) -> DataFrame:
    return binary.itch_orders(binary.write_itch(events(spark, sf))).drop("locate")


def ouch_parse(spark: SparkSession, sf: str) -> DataFrame:
    return binary.ouch_trades(binary.write_ouch(events(spark, sf)))


def symbols(names: DataFrame) -> DataFrame:
    """Ids for the distinct names, by rank. The distinct names of a market fit one task; rows do not pass it."""
    return names.select("name").distinct().select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("symbol"))


ANOMALY = ("symbol", "ts_ns", "detector", "type", "confidence", "magnitude", "hidden")
#: What a description begins with.
LABELS = {
    "TQR": "High trade-to-quote ratio", "SLIPPAGE": "Abnormal slippage", "BOOK": "Order book pressure", "REFILL": "Hidden refill", "HAWKES": "Self-exciting flow", "VPIN": "Toxic flow", "DRIFT": "Drift after large trades",
    "PIN_INTRADAY": "Informed trading at an hour", "PIN": "Informed trading", "CLUSTERING": "Trade clusters", "HMM": "Market regime",
}
#: Thresholds of the registered queries, wider than the defaults: these ticks are far apart and seldom meet a price twice.
GATES = Detectors(vpin_sigmas=liquidity.VPIN_SIGMAS, vpin_threshold=liquidity.VPIN_TOXIC, hawkes_threshold=liquidity.HAWKES_TIMES, price_step=liquidity.PRICE_STEP, refill_tolerance=liquidity.LOOSE, drift_information=trading.DRIFT_GATES["information"], drift_sigmas=trading.DRIFT_GATES["sigmas"], pin_least_trades=liquidity.PERIODS["least"], pin_period=liquidity.PERIODS["period"])


@dataclass(frozen=True)
class Market:
    """The inputs of all detectors; each may be narrowed to some symbols."""

    trades: DataFrame
    quotes: DataFrame
    orders: DataFrame
    books: DataFrame
    daily: DataFrame

    @staticmethod
    def of(spark: SparkSession, sf: str) -> Market:
        return Market(trades(spark, sf), quotes(spark, sf), orders(spark, sf), books(spark, sf), daily_trades(spark, sf))

    def only(self, symbols: list[int]) -> Market:
        return Market(*(getattr(self, f.name).where(F.col("symbol").isin(symbols)) for f in fields(self)))


def _named(rows: DataFrame, detector: str, kind: str | None = None) -> DataFrame:
    found = F.lit(kind).alias("type") if kind else F.col("type")
    return rows.select("symbol", "ts_ns", F.lit(detector).alias("detector"), found, *[F.col(c).cast("double").alias(c) for c in ("confidence", "magnitude", "hidden")])


def exact_findings(m: Market, d: Detectors) -> list[DataFrame]:
    """What the detectors find whose rules have an exact SQL form."""
    t, q, at = m.trades, m.quotes, m.trades.select("trade_seq", "ts_ns")
    day_end = (F.datediff(F.col("last_day"), F.lit("1970-01-01").cast("date")) + 1).cast("long") * trading.DAY - 1
    refill = liquidity.iceberg_best(m.orders, t, d.price_step, d.refill_tolerance)
    return [
        _named(trading.tqr_anomaly(t, q, d.tqr_window_ms * MINUTE, d.tqr_threshold).join(at, "trade_seq"), "TQR", "HIGH_TQR"),
        _named(trading.slippage_anomaly(t, q, d.slippage_lookback).join(at, "trade_seq"), "SLIPPAGE", "ABNORMAL_SLIPPAGE"),
        _named(liquidity.book_anomaly(m.books, t).join(q.select("quote_seq", "ts_ns"), "quote_seq"), "BOOK", "ORDER_BOOK_PRESSURE"),
        _named(refill, "REFILL", "HIDDEN_REFILL"),
        _named(liquidity.hawkes_anomaly(t, d.hawkes_threshold).join(at, "trade_seq"), "HAWKES", "ORDER_BOOK_PRESSURE"),
        _named(liquidity.vpin_anomaly(m.daily, d.vpin_sigmas, d.vpin_bucket, d.vpin_buckets, d.vpin_threshold).withColumn("ts_ns", day_end), "VPIN", "POST_TRADE_DRIFT"),
        _named(trading.drift_anomaly(t, q, d.drift_information, d.drift_sigmas), "DRIFT", "POST_TRADE_DRIFT"),
        _named(liquidity.intraday_spikes(t).withColumn("hidden", F.lit(0.0)), "PIN_INTRADAY", "MULTI_VENUE_SWEEP"),
    ]


def fitted_findings(m: Market, d: Detectors) -> list[DataFrame]:
    """What the detectors find that fit a model: informed trading, clusters, regimes."""
    month_end = F.unix_date(F.col("last")).cast("long") * trading.DAY
    pin = liquidity.pin_em(m.daily, d.pin_least_trades, d.pin_period).where(F.col("pin") > d.pin_threshold).withColumn("ts_ns", month_end).withColumn("magnitude", F.col("pin") / d.pin_threshold)
    return [
        _named(pin, "PIN", "MULTI_VENUE_SWEEP"),
        _named(models.cluster_anomaly(m.trades, m.quotes), "CLUSTERING", "TRADE_CLUSTERING"),
        _named(models.hmm_anomaly(m.trades, m.quotes, d.dark_probability, d.dark_streak), "HMM"),
    ]


def anomalies(found: list[DataFrame], d: Detectors) -> DataFrame:
    """One table of findings with descriptions; of a detector's findings in a symbol within a slot the first counts."""
    every = reduce(DataFrame.unionByName, found)
    slot = F.expr(f"ts_ns div {d.slot_ms * MINUTE}")
    first = every.groupBy("symbol", "detector", "type", slot.alias("slot")).agg(F.min(F.struct("ts_ns", "confidence", "magnitude", "hidden")).alias("a"))
    label = F.lit("Finding")
    for name, text in LABELS.items():
        label = F.when(F.col("detector") == name, text).otherwise(label)
    description = F.concat(label, F.lit(": confidence "), F.floor(F.col("a.confidence") * 100).cast("string"), F.lit(" %"))
    return first.select("symbol", "detector", "type", "a.ts_ns", "a.confidence", "a.magnitude", "a.hidden", description.alias("description"))


def anomalies_exact(spark: SparkSession, sf: str) -> DataFrame:
    return anomalies(exact_findings(Market.of(spark, sf), GATES), GATES)


def anomalies_all(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of all ten detectors."""
    m = Market.of(spark, sf)
    return anomalies([*exact_findings(m, GATES), *fitted_findings(m, GATES)], GATES)


def anomalies_json(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes {type, timestamp, sequence, data} of the anomalies, as the push channel carries them."""
    rows = anomalies_exact(spark, sf)
    data = F.struct("symbol", "detector", "type", _six("confidence").alias("confidence"), _six("magnitude").alias("magnitude"), "description")
    sequence = F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns", "detector", "type")) - 1
    return rows.select("symbol", "ts_ns", F.to_json(F.struct(F.lit("anomaly").alias("type"), F.col("ts_ns").alias("timestamp"), sequence.alias("sequence"), data.alias("data"))).alias("json"))


def _six(name: str) -> Column:
    """A double as text with six decimals, by whole millionths: no engine's own way of printing comes in."""
    n = F.round(F.abs(F.col(name)) * 1_000_000).cast("long")
    return F.concat(F.when(F.col(name) < 0, "-").otherwise(""), F.floor(n / 1_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def market_json(spark: SparkSession, sf: str) -> DataFrame:
    """Trades as JSON with prices in units."""
    price = F.format_string("%d.%04d", F.expr("price_e4 div 10000"), F.expr("price_e4 % 10000"))
    return trades(spark, sf).select("trade_seq", F.concat(F.lit('{"symbol":'), F.col("symbol").cast("string"), F.lit(',"price":"'), price, F.lit('","quantity":'), F.col("quantity").cast("string"), F.lit("}")).alias("json"))


def heatmap_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's grid: its size, the labels of the price cells that occur (percent from the reference price), and the
    cells with intensities as 0 to 255, ordered by age and price. A grid has 6000 cells at most."""
    cells = liquidity.heatmap_cells(trades(spark, sf)).select("symbol", "cell", F.struct("age", "cell", F.floor(F.col("intensity") * 255).alias("i")).alias("c"))
    grids = cells.groupBy("symbol").agg(F.sort_array(F.collect_list("c")).alias("cells"), F.sort_array(F.collect_set("cell")).alias("at"))
    labels = F.transform("at", lambda c: F.concat((c - 50).cast("string"), F.lit("%")))
    return grids.select("symbol", F.to_json(F.struct(F.lit(60).alias("rows"), F.lit(100).alias("columns"), labels.alias("labels"), "cells")).alias("json"))


def message_union(spark: SparkSession, sf: str) -> DataFrame:
    """All messages in one stream, with a discriminator and one struct for each kind: counts by kind and symbol."""
    t = trades(spark, sf).select(F.lit("TRADE").alias("msg_type"), "symbol", "ts_ns", F.struct("trade_seq", "price_e4", "quantity", "side").alias("trade"))
    q = quotes(spark, sf).select(F.lit("QUOTE").alias("msg_type"), "symbol", "ts_ns", F.struct("quote_seq", "bid_e4", "ask_e4").alias("quote"))
    b = books(spark, sf).select(F.lit("BOOK").alias("msg_type"), "symbol", "ts_ns", F.struct("bids", "asks").alias("book"))
    both = t.unionByName(q, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return both.groupBy("msg_type", "symbol").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ts"))


def vpin_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Where in time the volume buckets lie: buckets that end in each month."""
    t = daily_trades(spark, sf)
    run = F.sum("quantity").over(Window.partitionBy("symbol").orderBy(*liquidity.DAY_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    ends = t.withColumn("bucket", ((run - 1) / liquidity.BUCKET).cast("long")).groupBy("symbol", "bucket").agg(F.max("day").alias("day"))
    return ends.groupBy("symbol", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("buckets"))


QUERIES = {
    "fix_parse": fix_parse,
    "fix_checksums": fix_checksums,
    "itch_parse": itch_parse,
    "itch_orders": itch_order_parse,
    "itch_types": lambda spark, sf: binary.itch_types(binary.write_itch(events(spark, sf))),
    "itch_locates": lambda spark, sf: binary.itch_locates(binary.write_itch(events(spark, sf))),
    "ouch_orders": lambda spark, sf: binary.ouch_orders(binary.write_ouch(events(spark, sf))),
    "ouch_parse": ouch_parse,
    "anomalies_exact": anomalies_exact,
    "anomalies_all": anomalies_all,
    "anomalies_json": anomalies_json,
    "market_json": market_json,
    "heatmap_json": heatmap_json,
    "message_union": message_union,
    "vpin_by_month": vpin_by_month,
    "symbol_ids": lambda spark, sf: symbols(events(spark, sf).select(F.concat(F.lit("SYM"), F.col("symbol").cast("string")).alias("name"))),
}


def _sub(name: str, module) -> str:
    """A detector's SQL as a derived table."""
    return f"({module.SQL[name]})"


def _six_sql(name: str) -> str:
    n = f"CAST(round(abs({name}) * 1000000) AS BIGINT)"
    return f"CASE WHEN {name} < 0 THEN '-' ELSE '' END || ({n} // 1000000) || '.' || lpad(({n} % 1000000)::VARCHAR, 6, '0')"


_LABEL_SQL = "CASE detector" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_ANOMALIES_SQL = f"""{TICKS_SQL}, {DAILY_SQL}, uu AS (
  SELECT a.symbol, t.ts_ns, 'TQR' AS detector, 'HIGH_TQR' AS type, confidence, magnitude, hidden::DOUBLE AS hidden FROM {_sub('tqr_anomaly', trading)} a JOIN trades t USING (trade_seq)
  UNION ALL SELECT a.symbol, t.ts_ns, 'SLIPPAGE', 'ABNORMAL_SLIPPAGE', confidence, magnitude, hidden FROM {_sub('slippage_anomaly', trading)} a JOIN trades t USING (trade_seq)
  UNION ALL SELECT a.symbol, q.ts_ns, 'BOOK', 'ORDER_BOOK_PRESSURE', confidence, magnitude, hidden FROM {_sub('book_anomaly', liquidity)} a JOIN quotes q USING (quote_seq)
  UNION ALL SELECT symbol, ts_ns, 'REFILL', 'HIDDEN_REFILL', confidence, magnitude, hidden FROM {_sub('iceberg_best', liquidity)}
  UNION ALL SELECT a.symbol, t.ts_ns, 'HAWKES', 'ORDER_BOOK_PRESSURE', confidence, magnitude, hidden FROM {_sub('hawkes_anomaly', liquidity)} a JOIN trades t USING (trade_seq)
  UNION ALL SELECT symbol, (date_diff('day', DATE '1970-01-01', last_day) + 1) * {trading.DAY} - 1, 'VPIN', 'POST_TRADE_DRIFT', confidence, magnitude, hidden FROM {_sub('vpin_anomaly', liquidity)}
  UNION ALL SELECT symbol, ts_ns, 'DRIFT', 'POST_TRADE_DRIFT', confidence, magnitude, hidden FROM {_sub('drift_anomaly', trading)}
  UNION ALL SELECT a.symbol, t.ts_ns, 'PIN_INTRADAY', 'MULTI_VENUE_SWEEP', 0.7, round(pin / daily_average, 4), 0 FROM {_sub('intraday_pin_proxy', liquidity)} a JOIN (SELECT symbol, ts_ns // {HOUR} % 24 AS hour, max(ts_ns) AS ts_ns FROM trades GROUP BY ALL) t USING (symbol, hour) WHERE spike),
ay AS (SELECT symbol, detector, type, min((ts_ns, confidence, magnitude, hidden)) AS a FROM uu GROUP BY symbol, detector, type, ts_ns // {GATES.slot_ms * MINUTE}),
ax AS (SELECT symbol, detector, type, a[1] AS ts_ns, a[2] AS confidence, a[3] AS magnitude, a[4] AS hidden, {_LABEL_SQL} || ': confidence ' || CAST(floor(a[2] * 100) AS BIGINT) || ' %' AS description FROM ay)"""
SQL = {
    "fix_parse": f"""WITH {TICKS_SQL}, x AS (SELECT *, CASE event_type WHEN 'signup' THEN 'ORDER' WHEN 'view' THEN 'QUOTE' WHEN 'error' THEN NULL ELSE 'TRADE' END AS kind,
  CASE event_type WHEN 'click' THEN 'SELL' WHEN 'purchase' THEN 'BUY' ELSE CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END END AS sd, ts_ns % 86400000000000 // 1000000 * 1000000 AS tod_ns FROM ev)
SELECT kind, CASE WHEN kind <> 'QUOTE' THEN seq::VARCHAR END AS order_id_str, CASE WHEN kind IS NOT NULL THEN 'SYM' || symbol END AS symbol, CASE WHEN kind <> 'QUOTE' THEN sd END AS side, CASE WHEN kind <> 'QUOTE' THEN price_e4 END AS price_e4, CASE WHEN kind <> 'QUOTE' THEN (k + 1) * 100 END AS quantity,
  CASE WHEN kind = 'QUOTE' THEN price_e4 - 50 * (1 + k % 5) END AS bid_e4, CASE WHEN kind = 'QUOTE' THEN price_e4 + 50 * (1 + k % 5) END AS ask_e4, CASE WHEN kind = 'QUOTE' THEN (k + 1) * 100 ELSE 0 END AS bid_size, CASE WHEN kind = 'QUOTE' THEN (100 - k % 100) * 100 ELSE 0 END AS ask_size, tod_ns FROM x""",
    "fix_checksums": f"WITH {TICKS_SQL} SELECT seq, true AS ok FROM ev",
    "itch_parse": f"""WITH {TICKS_SQL}, x AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS sd FROM ev)
SELECT seq * 2 AS seq, seq AS order_id, 'SYM' || symbol AS symbol, price_e4, (k + 1) * 100 AS quantity, ts_ns % 86400000000000 AS ts_ns, sd AS side FROM x WHERE event_type IN ('purchase', 'click')
UNION ALL SELECT seq * 2 + 1, seq, 'SYM' || symbol, price_e4, (k + 1) * 100, ts_ns % 86400000000000, sd FROM x WHERE event_type = 'signup' AND k % 4 < 2""",
    "itch_types": f"""WITH {TICKS_SQL}, x AS (SELECT CASE WHEN event_type = 'signup' THEN 'A' WHEN event_type IN ('purchase', 'click') THEN 'P' ELSE 'X' END AS type FROM ev UNION ALL SELECT 'E' FROM ev WHERE event_type = 'signup' AND k % 4 < 2) SELECT type, count(*) AS n FROM x GROUP BY type""",
    "itch_orders": f"WITH {TICKS_SQL} SELECT seq * 2 AS seq, seq AS order_id, 'SYM' || symbol AS symbol, price_e4, (k + 1) * 100 AS quantity, ts_ns % 86400000000000 AS ts_ns, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM ev WHERE event_type = 'signup'",
    "itch_locates": f"WITH {TICKS_SQL} SELECT symbol AS locate, 'SYM' || symbol AS symbol, count(*) AS messages FROM ev WHERE event_type IN ('signup', 'purchase', 'click') GROUP BY ev.symbol",
    "ouch_orders": f"""WITH {TICKS_SQL}, e AS (SELECT *, (k + 1) * 100 AS quantity, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM ev WHERE event_type = 'signup')
SELECT seq * 4 AS seq, 'ENTERED' AS state, seq AS token, seq AS order_id, 'SYM' || symbol AS symbol, price_e4, quantity, NULL::BIGINT AS ts_ns, side FROM e UNION ALL SELECT seq * 4 + 1, 'ACCEPTED', seq, seq + 7, 'SYM' || symbol, price_e4, quantity, ts_ns % 86400000000000, side FROM e""",
    "ouch_parse": f"WITH {TICKS_SQL} SELECT seq * 4 + 2 AS seq, seq AS token, 'SYM' || symbol AS symbol, price_e4, (k + 1) * 100 AS quantity, ts_ns % 86400000000000 + 1000 AS ts_ns, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, k % 3 = 0 AS is_hidden FROM ev WHERE event_type = 'signup' AND k % 4 < 2",
    "anomalies_exact": f"WITH {_ANOMALIES_SQL} SELECT * FROM ax",
    "anomalies_json": f"""WITH {_ANOMALIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, detector, type) - 1 AS sequence FROM ax)
SELECT symbol, ts_ns, '{{"type":"anomaly","timestamp":' || ts_ns || ',"sequence":' || sequence || ',"data":{{"symbol":' || symbol || ',"detector":"' || detector || '","type":"' || type || '","confidence":"' || {_six_sql('confidence')} || '"' || coalesce(',"magnitude":"' || {_six_sql('magnitude')} || '"', '') || ',"description":"' || description || '"}}}}' AS json FROM n""",
    "heatmap_json": f"""WITH h AS (SELECT symbol, age, cell, CAST(floor(intensity * 255) AS BIGINT) AS i FROM {_sub('heatmap_cells', liquidity)})
SELECT symbol, '{{"rows":60,"columns":100,"labels":[' || list_aggregate(list_transform(list_sort(list_distinct(list(cell))), lambda c: '"' || (c - 50) || '%"'), 'string_agg', ',') || '],"cells":[' || string_agg('{{"age":' || age || ',"cell":' || cell || ',"i":' || i || '}}', ',' ORDER BY age, cell, i) || ']}}' AS json FROM h GROUP BY symbol""",
    "market_json": f"""WITH {TICKS_SQL} SELECT trade_seq, '{{"symbol":' || symbol || ',"price":"' || (price_e4 // 10000) || '.' || lpad((price_e4 % 10000)::VARCHAR, 4, '0') || '","quantity":' || quantity || '}}' AS json FROM trades""",
    "message_union": f"WITH {TICKS_SQL} SELECT 'TRADE' AS msg_type, symbol, count(*) AS n, min(ts_ns) AS first_ts FROM trades GROUP BY symbol UNION ALL SELECT 'QUOTE', symbol, count(*), min(ts_ns) FROM quotes GROUP BY symbol UNION ALL SELECT 'BOOK', symbol, count(*), min(ts_ns) FROM quotes GROUP BY symbol",
    "vpin_by_month": f"""WITH {liquidity._VPIN_SQL}, e AS (SELECT symbol, bucket, max(day) AS day FROM vb GROUP BY ALL) SELECT symbol, strftime(day, '%Y-%m') AS month, count(*) AS buckets FROM e GROUP BY ALL""",
    "symbol_ids": "SELECT name, row_number() OVER (ORDER BY name) AS symbol FROM (SELECT DISTINCT 'SYM' || (user_id % 10) AS name FROM events)",
}
