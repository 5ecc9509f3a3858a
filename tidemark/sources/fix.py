"""FIX tag=value messages: reading, decoding, and writing test messages. Fields are found between delimiters, so `6=` is
never found inside `56=`; of repeated tags the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOH = "\x01"
TAGS = {"order_id": 11, "exec_id": 37, "symbol": 55, "side": 54, "quantity": 38, "price": 44, "order_type": 40, "sent": 52, "exec_type": 150, "last_price": 31, "last_quantity": 32, "bid": 132, "ask": 133, "bid_size": 134, "ask_size": 135}
KINDS = {"1": "MARKET", "2": "LIMIT", "3": "STOP", "4": "STOP_LIMIT", "P": "PEGGED"}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message a line, as `value`."""
    return spark.read.text(path, lineSep="\n")


def field(tag: int, message: Column | None = None) -> Column:
    """The tag's text; null if it does not occur or is empty. Found by searching the bytes, without a regular expression."""
    text = F.concat(F.lit(SOH), F.col("value") if message is None else message)
    start = F.instr(text, F.lit(f"{SOH}{tag}="))
    return F.when(start > 0, F.nullif(F.substring_index(F.substr(text, start + len(f"{SOH}{tag}=")), SOH, 1), F.lit("")))


def day_ns(text: Column) -> Column:
    """Nanoseconds of the day in YYYYMMDD-HH:MM:SS[.mmm]; 0 for anything shorter."""
    part = lambda at, n: F.substring(text, at, n).try_cast("long")
    millis = F.coalesce(F.rpad(F.substring(text, 19, 3), 3, "0").try_cast("long"), F.lit(0))
    return F.when(F.length(text) >= 17, ((part(10, 2) * 60 + part(13, 2)) * 60 + part(16, 2)) * 1_000_000_000 + F.when(F.substring(text, 18, 1) == ".", millis).otherwise(0) * 1_000_000).otherwise(0)


def sent_at(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 17), F.lit("yyyyMMdd-HH:mm:ss"))


def checksum(message: Column) -> Column:
    """Sum of all bytes, modulo 256: each byte as a character of its own, whose number is added up."""
    return F.aggregate(F.split(F.decode(F.encode(message, "UTF-8"), "ISO-8859-1"), ""), F.lit(0), lambda a, x: a + F.ascii(x)) % 256


def checksum_ok(message: Column) -> Column:
    """Whether field 10 holds the checksum of all that comes before it."""
    body = F.concat(F.substring_index(message, f"{SOH}10=", 1), F.lit(SOH))
    return F.coalesce(checksum(body) == field(10, message).try_cast("long"), F.lit(False))


def decode(messages: DataFrame) -> DataFrame:
    """Orders (D), fills (8 with execution type 1, 2 or F) and quotes (S) with their required fields; `kind` is null for
    other types and for messages that lack or garble a required field."""
    f = {n: field(t) for n, t in TAGS.items()}
    number = lambda n: f[n].try_cast("long")
    price = lambda n: F.floor(f[n].try_cast("decimal(24,8)") * 10000).cast("long")  # noqa: E731  # exact, where doubles would lose a unit
    side = F.when(f["side"].isNotNull(), F.when(f["side"] == "1", "BUY").otherwise("SELL"))
    kind = F.lit("LIMIT")
    for k, name in KINDS.items():
        kind = F.when(f["order_type"] == k, name).otherwise(kind)
    rows = messages.select(
        "value", field(35).alias("msg"), F.coalesce(f["order_id"], f["exec_id"]).alias("order_id_str"), f["symbol"].alias("symbol"), side.alias("side"), F.coalesce(price("price"), price("last_price")).alias("price_e4"),
        F.coalesce(number("quantity"), number("last_quantity")).alias("quantity"), F.when(f["order_type"].isNotNull(), kind).alias("order_type"), f["exec_type"].alias("exec_type"), price("bid").alias("bid_e4"), price("ask").alias("ask_e4"),
        F.coalesce(number("bid_size"), F.lit(0)).alias("bid_size"), F.coalesce(number("ask_size"), F.lit(0)).alias("ask_size"), day_ns(f["sent"]).alias("tod_ns"),
    )
    whole = F.col("symbol").isNotNull() & F.col("order_id_str").isNotNull() & F.col("side").isNotNull() & F.col("price_e4").isNotNull() & F.col("quantity").isNotNull()
    order = (F.col("msg") == "D") & whole & F.col("order_type").isNotNull()
    fill = (F.col("msg") == "8") & whole & F.col("exec_type").isin("1", "2", "F")
    quote = (F.col("msg") == "S") & F.col("symbol").isNotNull() & F.col("bid_e4").isNotNull() & F.col("ask_e4").isNotNull()
    rows = rows.withColumn("kind", F.when(order, "ORDER").when(fill, "TRADE").when(quote, "QUOTE"))
    return rows.withColumn("order_id", F.coalesce(F.col("order_id_str").try_cast("long"), F.xxhash64("order_id_str"))).drop("value")


def write_events(events: DataFrame) -> DataFrame:
    """Messages for events, as `value` beside their `seq`: orders, fills and quotes, with checksums."""
    price = lambda e4: F.format_string("%s%d.%04d", F.when(F.expr(f"{e4} < 0"), "-").otherwise(""), F.expr(f"abs({e4}) div 10000"), F.expr(f"abs({e4}) % 10000"))
    rows = events.withColumn("_b", F.expr("price_e4 - 50 * (1 + k % 5)")).withColumn("_a", F.expr("price_e4 + 50 * (1 + k % 5)")).withColumn("_q", ((F.col("k") + 1) * 100).cast("string"))
    ts = F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyyMMdd-HH:mm:ss.SSS")
    join = lambda *xs: F.concat(*[F.concat(F.lit(f"{t}="), v if isinstance(v, Column) else F.lit(v), F.lit(SOH)) for t, v in xs])
    name, ident = F.concat(F.lit("SYM"), F.col("symbol").cast("string")), F.col("seq").cast("string")
    side = F.when(F.col("event_type") == "click", "2").when(F.col("event_type") == "purchase", "1").when(F.col("k") % 2 == 0, "1").otherwise("2")
    head = (8, "FIX.4.4")
    order = join(head, (35, "D"), (56, "X"), (11, ident), (55, name), (54, side), (38, F.col("_q")), (44, price("price_e4")), (40, "2"), (52, ts))
    fill = join(head, (35, "8"), (150, "F"), (37, ident), (55, name), (31, price("price_e4")), (32, F.col("_q")), (54, side), (52, ts))
    quote = join(head, (35, "S"), (55, name), (132, price("_b")), (133, price("_a")), (134, F.col("_q")), (135, ((100 - F.col("k") % 100) * 100).cast("string")), (52, ts))
    other = join(head, (35, "0"), (52, ts))
    body = F.when(F.col("event_type") == "signup", order).when(F.col("event_type").isin("purchase", "click"), fill).when(F.col("event_type") == "view", quote).otherwise(other)
    return rows.select("seq", body.alias("_m")).select("seq", F.concat("_m", F.lit("10="), F.lpad(checksum(F.col("_m")).cast("string"), 3, "0"), F.lit(SOH)).alias("value"))
