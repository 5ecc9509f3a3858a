"""Structured Streaming forms: sources, windows with watermarks, keyed state, sinks. They share the columns of the batch
adapters. Event time is microseconds made from ts_ns; late rows are dropped by the watermark, never at random, and a
source is slowed down by its own options instead of losing messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """Rows of Parquet files as they arrive; in production a log takes the place of the folder."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000")))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP feed as `value`, for trying things out: a socket cannot be read again after a failure, so production
    feeds go through a log. FIX lines decode with sources.fix.decode as they do in batch."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def once(rows: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark([key])


def bars(trades: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume of tumbling windows, once a window is complete."""
    order = F.struct("ts_ns", "trade_seq")
    out = trades.withWatermark("event_time", late).groupBy("symbol", F.window("event_time", width)).agg(F.min_by("price_e4", order).alias("open"), F.max("price_e4").alias("high"), F.min("price_e4").alias("low"), F.max_by("price_e4", order).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"))
    return out.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "trades")


def tqr(trades: DataFrame, quotes: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Trades per quote in tumbling or sliding windows."""
    both = trades.select("symbol", "event_time", F.lit(1).alias("t"), F.lit(0).alias("q")).unionByName(quotes.select("symbol", "event_time", F.lit(0).alias("t"), F.lit(1).alias("q")))
    sums = both.withWatermark("event_time", late).groupBy("symbol", F.window("event_time", width, slide or width)).agg(F.sum("t").alias("n_trades"), F.sum("q").alias("n_quotes"))
    return sums.select("symbol", F.col("window.start").alias("start"), "n_trades", "n_quotes", F.when(F.col("n_quotes") > 0, F.col("n_trades") / F.col("n_quotes")).otherwise(F.lit(float("inf"))).alias("ratio"))


def sessions(orders: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Orders at a price level without a silence between them."""
    out = orders.withWatermark("event_time", late).groupBy("symbol", "side", "price_e4", F.session_window("event_time", gap)).agg(F.count("*").alias("refills"), F.avg("quantity").alias("avg_size"))
    return out.select("symbol", "side", "price_e4", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "refills", "avg_size")


def volume_buckets(trades: DataFrame, bucket: int = 50_000) -> DataFrame:
    """Buckets of volume with their overshoot, closed as trades arrive. State by symbol: bucket number and three sums."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, total, buy, sell = state.get if state.exists else (0, 0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "trade_seq"])
        out = []
        for q, side in zip(rows.quantity.tolist(), rows.side.tolist(), strict=True):
            total += q
            buy += q if side == "BUY" else q / 2 if side == "UNKNOWN" else 0
            sell += q if side == "SELL" else q / 2 if side == "UNKNOWN" else 0
            if total >= bucket:
                out.append((key[0], number, total, buy, sell, abs(buy - sell) / total))
                number, total, buy, sell = number + 1, 0, 0.0, 0.0
        state.update((number, total, buy, sell))
        yield pd.DataFrame(out, columns=["symbol", "bucket", "volume", "buy", "sell", "imbalance"])

    return trades.groupBy("symbol").applyInPandasWithState(step, "symbol long, bucket long, volume long, buy double, sell double, imbalance double", "number long, total long, buy double, sell double", "append", GroupStateTimeout.NoTimeout)


def intensity(trades: DataFrame, mu: float = 0.5, alpha: float = 0.3, cross: float = 0.1, beta: float = 0.1, unit_ns: int = 60_000_000_000) -> DataFrame:
    """Self-exciting intensities just before each trade. State by symbol: time and two decayed sums."""
    import math

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, b, s = state.get if state.exists else (None, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "trade_seq"])
        out = []
        for seq, ts, q, side in zip(rows.trade_seq.tolist(), rows.ts_ns.tolist(), rows.quantity.tolist(), rows.side.tolist(), strict=True):
            ts = ts if last is None else max(ts, last)  # what comes late counts as of now
            fade = math.exp(-beta * (ts - last) / unit_ns) if last is not None else 0.0
            b, s, last = b * fade, s * fade, ts
            out.append((key[0], seq, ts, mu + alpha * b + cross * s, mu + alpha * s + cross * b))
            m = math.log1p(q / 1000) * beta
            b, s = (b + m, s) if side == "BUY" else (b, s + m)
        state.update((last, b, s))
        yield pd.DataFrame(out, columns=["symbol", "trade_seq", "ts_ns", "buy", "sell"])

    return trades.groupBy("symbol").applyInPandasWithState(step, "symbol long, trade_seq long, ts_ns long, buy double, sell double", "last long, b double, s double", "append", GroupStateTimeout.NoTimeout)


ALERT = "symbol long, ts_ns long, detector string, type string, confidence double, magnitude double"


def tqr_alerts(trades: DataFrame, quotes: DataFrame, limit: float = 2.5, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Windows whose trades per quote exceed the limit."""
    rows = tqr(trades, quotes, width, slide, late).where((F.col("ratio") > limit) & (F.col("n_quotes") > 0))
    return rows.select("symbol", (F.unix_micros("start") * 1000).alias("ts_ns"), F.lit("TQR").alias("detector"), F.lit("HIGH_TQR").alias("type"), F.least(F.lit(1.0), (F.col("ratio") - limit) / limit).alias("confidence"), (F.col("ratio") / limit).alias("magnitude"))


def intensity_alerts(trades: DataFrame, baseline: float, times: float = 3.0, **model: float) -> DataFrame:
    """Trades at which the total intensity exceeds `times` the baseline."""
    rows = intensity(trades, **model).withColumn("total", F.col("buy") + F.col("sell")).where(F.col("total") > times * baseline)
    return rows.select("symbol", "ts_ns", F.lit("HAWKES").alias("detector"), F.lit("ORDER_BOOK_PRESSURE").alias("type"), F.least(F.lit(1.0), F.col("total") / (times * baseline) - 1).alias("confidence"), (F.col("total") / baseline).alias("magnitude"))


def toxic_alerts(trades: DataFrame, bucket: int = 50_000, keep: int = 50, least: int = 10, toxic: float = 0.3, sigmas: float = 2.0) -> DataFrame:
    """Volume buckets after which the mean imbalance of the last `keep` is toxic and far over that of all so far. State by
    symbol: the open bucket, moments of all imbalances, and the last ones."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, buy, sell, n, s, s2, last = state.get if state.exists else (0, 0.0, 0.0, 0, 0.0, 0.0, [])
        last = list(last)
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "trade_seq"])
        out = []
        for ts, q, side in zip(rows.ts_ns.tolist(), rows.quantity.tolist(), rows.side.tolist(), strict=True):
            total += q
            buy += q if side == "BUY" else q / 2 if side == "UNKNOWN" else 0
            sell += q if side == "SELL" else q / 2 if side == "UNKNOWN" else 0
            if total < bucket:
                continue
            i = abs(buy - sell) / total
            n, s, s2, last = n + 1, s + i, s2 + i * i, [*last, i][-keep:]
            total, buy, sell = 0, 0.0, 0.0
            mean, sd = sum(last) / len(last), max(0.0, s2 / n - (s / n) ** 2) ** 0.5
            z = (mean - s / n) / sd if sd > 1e-9 else 0.0
            if n >= least and mean > toxic and z > sigmas:
                out.append((key[0], ts, "VPIN", "POST_TRADE_DRIFT", min(1.0, z / 4), mean / toxic))
        state.update((total, buy, sell, n, s, s2, last))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ALERT.split(", ")])

    return trades.groupBy("symbol").applyInPandasWithState(step, ALERT, "total long, buy double, sell double, n long, s double, s2 double, last array<double>", "append", GroupStateTimeout.NoTimeout)


def slippage_alerts(trades: DataFrame, quotes: DataFrame, least: int = 5, sigmas: float = 2.0) -> DataFrame:
    """Trades whose distance from the last mid is far from the mean so far. State by symbol: the mid and three moments."""
    own = ["symbol", "ts_ns", "side", "price_e4", "mid"]
    both = trades.withColumn("mid", F.lit(None).cast("double")).select(*own).unionByName(quotes.select("symbol", "ts_ns", F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("price_e4"), ((F.col("bid_e4") + F.col("ask_e4")) / 2.0).alias("mid")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mid, n, s, s2 = state.get if state.exists else (0.0, 0, 0.0, 0.0)
        rows = pd.concat(list(batches))
        rows = rows.assign(late=rows.side.notna()).sort_values(["ts_ns", "late"])  # a quote goes before the trades of its time
        out = []
        for ts, side, price, quote in zip(rows.ts_ns.tolist(), rows.side.tolist(), rows.price_e4.tolist(), rows.mid.tolist(), strict=True):
            if not isinstance(side, str):
                mid = quote
                continue
            if mid <= 0:
                continue
            gap = (price - mid) / mid * (1 if side == "BUY" else -1)
            n, s, s2 = n + 1, s + gap, s2 + gap * gap
            sd = max(0.0, s2 / n - (s / n) ** 2) ** 0.5
            z = (gap - s / n) / sd if sd > 1e-9 else 0.0
            if n >= least and abs(z) > sigmas:
                out.append((key[0], ts, "SLIPPAGE", "ABNORMAL_SLIPPAGE", min(1.0, abs(z) / 5), gap / (s / n) if s else 0.0))
        state.update((float(mid), n, s, s2))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ALERT.split(", ")])

    return both.groupBy("symbol").applyInPandasWithState(step, ALERT, "mid double, n long, s double, s2 double", "append", GroupStateTimeout.NoTimeout)


def console(rows: DataFrame, mode: str = "append") -> StreamingQuery:
    """Batches printed by the driver, for looking at."""
    return rows.writeStream.format("console").outputMode(mode).option("truncate", "false").trigger(availableNow=True).start()


def push(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Hand each batch to a function; with the batch number it can write once even if a batch is tried again."""
    writer = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def json_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Batches as JSON lines, one folder for each batch: written again, not twice, when a batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return write


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last batch, as gauges for a metrics page."""
    last = query.lastProgress or {}
    return {"input_rows": float(last.get("numInputRows", 0)), "rows_per_second": float(last.get("processedRowsPerSecond", 0) or 0), "batch": float(last.get("batchId", -1))}


def exposition(gauges: dict[str, float], prefix: str = "tidemark") -> str:
    """Gauges in the text format that metric collectors read."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v:g}\n" for k, v in sorted(gauges.items()))
