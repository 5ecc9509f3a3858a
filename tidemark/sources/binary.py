"""Length-prefixed binary feeds: ITCH 5.0 and OUCH. Splitting a file into frames is sequential; everything after it is
column expressions over the frames. Frames of unknown types are kept and counted, never the end of a packet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "path string, seq long, frame binary"
ITCH_TYPES = "SRHYLVWKJhAFECXDUPQBI"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            frames, at = [], 0
            while at + 3 <= len(data):
                end = at + 2 + int.from_bytes(data[at : at + 2], "big")
                if end > len(data):
                    break
                frames.append(data[at:end])
                at = end
                if len(frames) == 10_000:
                    yield _rows(path, frames, at)
                    frames = []
            yield _rows(path, frames, at)


def _rows(path: str, frames: list[bytes], end: int) -> pa.RecordBatch:
    starts = []
    for f in reversed(frames):
        end -= len(f)
        starts.append(end)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(frames), pa.string()), pa.array(starts[::-1], pa.int64()), pa.array(frames, pa.binary())], ["path", "seq", "frame"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, seq (the frame's place in its file) and frame. A truncated frame ends its file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, FRAMES)


def be(at: int, n: int) -> Column:
    """A big-endian number of n bytes at an offset."""
    return F.conv(F.hex(F.substring("frame", at + 1, n)), 16, 10).cast("long")


def text(at: int, n: int) -> Column:
    return F.rtrim(F.decode(F.substring("frame", at + 1, n), "US-ASCII"))


def _side(at: int) -> Column:
    return F.when(text(at, 1) == "B", "BUY").when(text(at, 1) == "S", "SELL").otherwise("UNKNOWN")


def itch_types(frames: DataFrame) -> DataFrame:
    """How often each message type comes."""
    return frames.groupBy(text(2, 1).alias("type")).agg(F.count("*").alias("n"))


def itch_orders(frames: DataFrame, scale: int = 1) -> DataFrame:
    """Add orders (A, F). scale: factor to ten-thousandths."""
    rows = frames.where(text(2, 1).isin("A", "F") & (F.octet_length("frame") >= 38))
    return rows.select("seq", be(13, 8).alias("order_id"), be(3, 2).alias("locate"), text(26, 8).alias("symbol"), (be(34, 4) * scale).alias("price_e4"), be(22, 4).alias("quantity"), be(7, 6).alias("ts_ns"), _side(21).alias("side"))


def itch_trades(frames: DataFrame, scale: int = 1) -> DataFrame:
    """Trades (P), and executions (E, C) with symbol, price and side of their resting order; those of unknown orders are dropped.
    One pass over the frames: executions and orders meet by order number, trades each keep a place of their own."""
    kind = text(2, 1)
    length = F.octet_length("frame")
    whole = kind.isin("A", "F", "P") & (length >= 38)
    rows = frames.where(whole | (kind.isin("E", "C") & (length >= 33))).select(
        "seq", kind.alias("kind"), be(13, 8).alias("order_id"), be(7, 6).alias("ts_ns"), F.when(whole, be(22, 4)).otherwise(be(21, 4)).alias("quantity"),
        F.when(whole, F.struct("seq", text(26, 8).alias("symbol"), (be(34, 4) * scale).alias("price_e4"), _side(21).alias("side"))).alias("own"),
    )
    meet = Window.partitionBy(F.when(F.col("kind") == "P", -1 - F.col("seq")).otherwise(F.col("order_id")))
    rows = rows.withColumn("order", F.max(F.when(F.col("kind").isin("A", "F"), F.col("own"))).over(meet)).where("kind in ('P', 'E', 'C')")
    rows = rows.withColumn("of", F.coalesce("own", "order")).where("of is not null")
    return rows.select("seq", "order_id", "of.symbol", "of.price_e4", "quantity", "ts_ns", "of.side")


def ouch_orders(frames: DataFrame) -> DataFrame:
    """Entered (O: no time of its own) and accepted (A) orders."""
    kind = text(3, 1)
    rows = frames.where(kind.isin("O", "A") & (F.octet_length("frame") >= 25))
    entered = rows.where(kind == "O").select("seq", F.lit("ENTERED").alias("state"), be(4, 4).alias("token"), be(4, 4).alias("order_id"), text(13, 8).alias("symbol"), be(21, 4).alias("price_e4"), be(9, 4).alias("quantity"), F.lit(None).cast("long").alias("ts_ns"), _side(8).alias("side"))
    accepted = rows.where((kind == "A") & (F.octet_length("frame") >= 50)).select("seq", F.lit("ACCEPTED").alias("state"), be(12, 4).alias("token"), be(42, 8).alias("order_id"), text(21, 8).alias("symbol"), be(29, 4).alias("price_e4"), be(17, 4).alias("quantity"), be(4, 8).alias("ts_ns"), _side(16).alias("side"))
    return entered.unionByName(accepted)


def ouch_trades(frames: DataFrame) -> DataFrame:
    """Executions (E) with symbol and side of their token's order; hidden if the liquidity flag is R or K. One pass, as above."""
    kind, length = text(3, 1), F.octet_length("frame")
    entered, accepted, done = (kind == "O") & (length >= 25), (kind == "A") & (length >= 50), (kind == "E") & (length >= 33)
    rows = frames.where(entered | accepted | done).select(
        "seq", done.alias("done"), F.when(entered, be(4, 4)).otherwise(be(12, 4)).alias("token"), be(20, 4).alias("price_e4"), be(16, 4).alias("quantity"), be(4, 8).alias("ts_ns"), F.when(done, text(24, 1).isin("R", "K")).alias("is_hidden"),
        F.when(entered, F.struct("seq", text(13, 8).alias("symbol"), _side(8).alias("side"))).when(accepted, F.struct("seq", text(21, 8).alias("symbol"), _side(16).alias("side"))).alias("own"),
    )
    rows = rows.withColumn("of", F.max("own").over(Window.partitionBy("token"))).where("done and of is not null")
    return rows.select("seq", "token", "of.symbol", "price_e4", "quantity", "ts_ns", "of.side", "is_hidden")


def _hex(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value), 2 * n, "0")


def _chars(value: Column, n: int) -> Column:
    return F.hex(F.encode(F.rpad(value, n, " "), "US-ASCII"))


def _frame(*parts: Column) -> Column:
    body = F.concat(*parts)
    return F.unhex(F.concat(_hex((F.length(body) / 2).cast("long"), 2), body))


def write_itch(events: DataFrame) -> DataFrame:
    """Frames for events: orders (A), executions (E) of half the orders, trades (P), and cancels (X) for the rest."""
    day = F.col("ts_ns") % 86_400_000_000_000
    name, side = _chars(F.concat(F.lit("SYM"), F.col("symbol").cast("string")), 8), F.hex(F.when(F.col("k") % 2 == 0, "B").otherwise("S"))
    head = lambda t: (F.lit(t.encode().hex().upper()), _hex(F.col("symbol"), 2), _hex(F.lit(0), 2), _hex(day, 6), _hex(F.col("seq"), 8))
    size = _hex((F.col("k") + 1) * 100, 4)
    add = _frame(*head("A"), side, size, name, _hex(F.col("price_e4"), 4))
    done = _frame(*head("E"), size, _hex(F.col("seq"), 8))
    trade = _frame(*head("P"), side, size, name, _hex(F.col("price_e4"), 4), _hex(F.col("seq"), 8))
    cancel = _frame(*head("X"), size)
    first = F.when(F.col("event_type") == "signup", add).when(F.col("event_type").isin("purchase", "click"), trade).otherwise(cancel)
    rows = events.select("seq", (F.col("seq") * 2).alias("n"), first.alias("frame")).unionByName(events.where("event_type = 'signup' and k % 4 < 2").select("seq", (F.col("seq") * 2 + 1).alias("n"), done.alias("frame")))
    return rows.select(F.lit("generated").alias("path"), F.col("n").alias("seq"), "frame")


def itch_locates(frames: DataFrame) -> DataFrame:
    """The locate dimension: each locate's symbol as its first message with one names it."""
    rows = frames.where(text(2, 1).isin("A", "F", "P") & (F.octet_length("frame") >= 38))
    return rows.groupBy(be(3, 2).alias("locate")).agg(F.min_by(text(26, 8), "seq").alias("symbol"), F.count("*").alias("messages"))


def write_ouch(events: DataFrame) -> DataFrame:
    """Frames for events: entered (O) and accepted (A) orders and executions (E) of half of them."""
    day = F.col("ts_ns") % 86_400_000_000_000
    name, side = _chars(F.concat(F.lit("SYM"), F.col("symbol").cast("string")), 8), F.hex(F.when(F.col("k") % 2 == 0, "B").otherwise("S"))
    size, u = _hex((F.col("k") + 1) * 100, 4), F.lit(b"U".hex())
    entered = _frame(u, F.lit("4F"), _hex(F.col("seq"), 4), side, size, name, _hex(F.col("price_e4"), 4))
    accepted = _frame(u, F.lit("41"), _hex(day, 8), _hex(F.col("seq"), 4), side, size, name, _hex(F.col("price_e4"), 4), _hex(F.lit(0), 4), _chars(F.lit("FIRM"), 4), F.lit("59"), _hex(F.col("seq") + 7, 8), _hex(F.lit(0), 8))
    done = _frame(u, F.lit("45"), _hex(day + 1000, 8), _hex(F.col("seq"), 4), size, _hex(F.col("price_e4"), 4), F.hex(F.when(F.col("k") % 3 == 0, "R").otherwise("A")), _hex(F.col("seq"), 8))
    e = events.where("event_type = 'signup'")
    rows = e.select((F.col("seq") * 4).alias("n"), entered.alias("frame")).unionByName(e.select((F.col("seq") * 4 + 1).alias("n"), accepted.alias("frame")))
    rows = rows.unionByName(e.where("k % 4 < 2").select((F.col("seq") * 4 + 2).alias("n"), done.alias("frame")))
    return rows.select(F.lit("generated").alias("path"), F.col("n").alias("seq"), "frame")
