"""Synthetic ticks with known anomalies: seeded by hashes, so any number of rows comes out alike on any cluster.

Of all messages 70 % are quotes, 20 % trades and 10 % orders. Each symbol gets one of every injected pattern, at places
that its number says; `labels` tells where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1_000_000_000
PATTERNS = ("ICEBERG", "SPOOFING", "DARK_POOL", "SWEEP")


def _draw(seed: int, name: str) -> Column:
    """Uniform in [0, 1) from the message's number."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1 << 30)) / float(1 << 30)


def generate(spark: SparkSession, messages: int, symbols: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """trades, quotes, orders and labels."""
    base = spark.range(messages).withColumn("symbol", F.col("id") % symbols).withColumn("ts_ns", (F.col("id") + 1) * STEP)
    wave = 1_000_000 + F.col("symbol") * 50_000 + (20_000 * F.sin(F.col("id") / 5000.0)).cast("long")
    base = base.withColumn("price_e4", wave + F.floor((_draw(seed, "noise") - 0.5) * 400)).withColumn("kind", _draw(seed, "kind")).withColumn("side", F.when(_draw(seed, "side") < 0.5, "BUY").otherwise("SELL"))
    size = (F.floor(_draw(seed, "size") * 9) + 1) * 100
    quotes = base.where("kind < 0.7").select(F.col("id").alias("quote_seq"), "symbol", (F.col("price_e4") - 50).alias("bid_e4"), (F.col("price_e4") + 50).alias("ask_e4"), size.alias("bid_size"), size.alias("ask_size"), "ts_ns", F.lit(0).alias("venue"))
    trades = base.where("kind >= 0.7 and kind < 0.9").select(F.col("id").alias("trade_seq"), F.col("id").alias("order_id"), "symbol", "price_e4", size.alias("quantity"), "ts_ns", "side", F.lit(0).alias("venue"), F.lit(False).alias("is_hidden"))
    orders = base.where("kind >= 0.9").select(F.col("id").alias("order_id"), "symbol", "price_e4", size.alias("quantity"), size.alias("remaining_quantity"), "ts_ns", "side", F.lit("LIMIT").alias("order_type"), F.lit(0).alias("venue"))

    marks = spark.range(symbols).select(F.col("id").alias("symbol"), F.posexplode(F.array(*map(F.lit, PATTERNS))).alias("p", "type"))
    marks = marks.withColumn("ts_ns", (F.lit(messages * STEP) * (F.col("p") + 1) / 5).cast("long") + F.col("symbol") * 1000)
    burst = marks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("ts_ns", F.col("ts_ns") + F.col("i") * 1_000_000)
    ident = messages + (F.col("symbol") * len(PATTERNS) + F.col("p")) * 10 + F.col("i")
    price = 1_000_000 + F.col("symbol") * 50_000
    ice = burst.where("type = 'ICEBERG'").select(ident.alias("order_id"), "symbol", price.alias("price_e4"), F.lit(1000).cast("long").alias("quantity"), F.lit(1000).cast("long").alias("remaining_quantity"), "ts_ns", F.lit("BUY").alias("side"), F.lit("LIMIT").alias("order_type"), F.lit(0).alias("venue"))
    spoof = burst.where("type = 'SPOOFING'").select(ident.alias("quote_seq"), "symbol", (price - 50).alias("bid_e4"), (price + 50).alias("ask_e4"), F.lit(90_000).cast("long").alias("bid_size"), F.lit(100).cast("long").alias("ask_size"), "ts_ns", F.lit(0).alias("venue"))
    prints = burst.where("type in ('DARK_POOL', 'SWEEP')")
    dark = F.col("type") == "DARK_POOL"
    hits = prints.select(ident.alias("trade_seq"), ident.alias("order_id"), "symbol", (price + F.when(dark, 0).otherwise(F.col("i") * 20)).alias("price_e4"), F.when(dark, 25_000).otherwise(2_000).cast("long").alias("quantity"), "ts_ns", F.lit("BUY").alias("side"), F.when(dark, 16).otherwise(F.col("i") % 5).alias("venue"), dark.alias("is_hidden"))
    labels = marks.select("ts_ns", "symbol", "type", F.concat(F.lit("injected "), F.lower("type")).alias("description"), F.lit("HIGH").alias("severity"))
    return {"trades": trades.unionByName(hits), "quotes": quotes.unionByName(spoof), "orders": orders.unionByName(ice), "labels": labels}
