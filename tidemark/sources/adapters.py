"""Market data out of the general tables: ticks from events, daily trades from lineitem, vectors from embeddings.

Minutes stand for the milliseconds of a live feed: events come minutes apart, so windows are parameters in MINUTE.
Each adapter has a twin in SQL (TICKS_SQL, DAILY_SQL), as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000_000_000
HOUR = 60 * MINUTE
#: Venues that the suppliers are dealt over: as many as a router holds at most.
VENUES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: every event. A price can be 0, and a quote's bid below it; formulas that divide by prices allow for that."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 10).alias("symbol"),
        (F.col("user_id") % 5).cast("int").alias("venue"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000").alias("ts_ns"),
        "event_type",
        F.round(F.col("value") * 10000).cast("long").alias("price_e4"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "click", "SELL").otherwise("UNKNOWN")
    rows = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "click", "error"))
    return rows.select(
        F.col("seq").alias("trade_seq"), F.col("seq").alias("order_id"), "symbol", "price_e4", ((F.col("k") + 1) * 100).alias("quantity"), "ts_ns", side.alias("side"), "venue",
        (F.col("event_type") == "error").alias("is_hidden"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = 50 * (1 + F.col("k") % 5)
    return events(spark, sf_dir).where("event_type = 'view'").select(
        F.col("seq").alias("quote_seq"), "symbol", (F.col("price_e4") - half).alias("bid_e4"), (F.col("price_e4") + half).alias("ask_e4"),
        ((F.col("k") + 1) * 100).alias("bid_size"), ((100 - F.col("k") % 100) * 100).alias("ask_size"), "ts_ns", "venue",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = ((F.col("k") + 1) * 100).alias("quantity")
    return events(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("seq").alias("order_id"), "symbol", "price_e4", quantity, quantity.alias("remaining_quantity"), "ts_ns",
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit("LIMIT").alias("order_type"), "venue",
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and what becomes of each: executed whole, executed in part, cancelled, or replaced by a smaller one."""
    o = orders(spark, sf_dir).withColumn("k", F.expr("quantity div 100 - 1"))
    entered = o.select("order_id", F.lit(0).alias("event_no"), "symbol", "venue", "side", "price_e4", "quantity", "ts_ns", F.lit("NEW").alias("kind"))
    case = lambda a, b, c, d: F.when(F.col("k") % 4 == 0, a).when(F.col("k") % 4 == 1, b).when(F.col("k") % 4 == 2, c).otherwise(d)
    later = o.select(
        "order_id", F.lit(1).alias("event_no"), "symbol", "venue", "side", (F.col("price_e4") + F.when(F.col("k") % 4 == 3, 100).otherwise(0)).alias("price_e4"), case(F.col("quantity"), F.lit(100), F.col("quantity"), F.expr("quantity div 2")).cast("long").alias("quantity"),
        (F.col("ts_ns") + case(F.lit(30), F.lit(90), F.lit(120), F.lit(20)).cast("long") * F.lit(1_000_000_000)).alias("ts_ns"), case(F.lit("EXEC"), F.lit("EXEC"), F.lit("CANCEL"), F.lit("REPLACE")).alias("kind"),
    )
    return entered.unionByName(later)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten levels a side below and above each quote; level i holds the first one's size and i hundreds more or less."""

    def side(price: str, size: str, sign: int, step: int):
        level = lambda i: F.struct((F.col(price) + sign * 100 * i).alias("price_e4"), F.greatest(F.lit(100), F.col(size) + step * i).alias("quantity"), (i + 1).cast("int").alias("order_count"))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")), level)

    return quotes(spark, sf_dir).select("quote_seq", "symbol", "ts_ns", "venue", side("bid_e4", "bid_size", -1, 100).alias("bids"), side("ask_e4", "ask_size", 1, -100).alias("asks"))


#: Joined columns that make every row of lineitem unique, as an order within a day.
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def daily_trades(spark: SparkSession, sf_dir: str, symbols: int = 5) -> DataFrame:
    """Trades of days: no time of day, so `ts_ns` is the day's and ROW_KEY gives the order within it."""
    side = F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL").otherwise("UNKNOWN")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % symbols).alias("symbol"), F.col("l_shipdate").cast("date").alias("day"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 10000).cast("long").alias("price_e4"), (F.floor("l_quantity") * 100).cast("long").alias("quantity"),
        side.alias("side"), (F.col("l_linestatus") == "F").alias("is_hidden"), (F.col("l_suppkey") % 5).cast("int").alias("venue"), *ROW_KEY,
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, dealt over VENUES venues; a venue's figures are the means of what its suppliers' numbers give."""
    n, rows = F.col("s_suppkey"), F.count("*")
    own = table(spark, sf_dir, "supplier").groupBy((n % VENUES).alias("venue")).agg(
        *[F.sum(x).alias(name) for name, x in (("a", n % 7), ("b", n % 6), ("c", n % 5), ("d", n % 4), ("e", n % 3), ("f", n * 37 % 400), ("r", n % 10), ("w", n % 8))], rows.alias("n"), F.count_if(n % 2 == 0).alias("h")
    )
    mean = lambda c: F.col(c) / F.col("n")
    return own.select(
        "venue", F.concat(F.lit("V"), F.col("venue").cast("string")).alias("venue_id"), (1 + mean("a")).alias("avg_spread_bps"), (0.3 + mean("b") / 10.0).alias("fill_probability"), (200 * (1 + mean("c"))).alias("avg_fill_size"),
        (mean("d") / 2.0).alias("impact_bps"), (mean("e") / 10.0).alias("fee_bps"), F.expr("100 + f div n").alias("avg_latency_us"), (2 * F.col("h") >= F.col("n")).alias("supports_hidden"),
        (mean("r") / 10.0).alias("recent_fill_rate"), (mean("w") / 8.0).alias("queue_position"),
    )


TICKS_SQL = """
ev AS (SELECT event_id AS seq, user_id % 10 AS symbol, (user_id % 5)::INT AS venue, epoch_us(ts) * 1000 AS ts_ns, event_type,
  CAST(round(value * 10000) AS BIGINT) AS price_e4, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
trades AS (SELECT seq AS trade_seq, symbol, venue, price_e4, (k + 1) * 100 AS quantity, ts_ns, event_type = 'error' AS is_hidden,
  CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM ev WHERE event_type IN ('purchase', 'click', 'error')),
quotes AS (SELECT seq AS quote_seq, symbol, venue, ts_ns, price_e4 - 50 * (1 + k % 5) AS bid_e4, price_e4 + 50 * (1 + k % 5) AS ask_e4,
  (k + 1) * 100 AS bid_size, (100 - k % 100) * 100 AS ask_size FROM ev WHERE event_type = 'view'),
orders_in AS (SELECT seq AS order_id, symbol, venue, ts_ns, price_e4, (k + 1) * 100 AS quantity, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM ev WHERE event_type = 'signup')"""

ORDER_EVENTS_SQL = """
oe AS (SELECT order_id, 0 AS event_no, symbol, venue, side, price_e4, quantity, ts_ns, 'NEW' AS kind FROM orders_in
  UNION ALL SELECT order_id, 1, symbol, venue, side, price_e4 + CASE WHEN k % 4 = 3 THEN 100 ELSE 0 END, CASE k % 4 WHEN 1 THEN 100 WHEN 3 THEN quantity // 2 ELSE quantity END, ts_ns + CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 90 WHEN 2 THEN 120 ELSE 20 END::BIGINT * 1000000000,
    CASE k % 4 WHEN 2 THEN 'CANCEL' WHEN 3 THEN 'REPLACE' ELSE 'EXEC' END FROM (SELECT *, quantity // 100 - 1 AS k FROM orders_in))"""

DAILY_SQL = """
daily AS (SELECT l_suppkey % 5 AS symbol, l_shipdate::DATE AS day, CAST(round(l_extendedprice / l_quantity * 10000) AS BIGINT) AS price_e4,
  CAST(floor(l_quantity) AS BIGINT) * 100 AS quantity, CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'UNKNOWN' END AS side,
  l_linestatus = 'F' AS is_hidden, (l_suppkey % 5)::INT AS venue, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"""
