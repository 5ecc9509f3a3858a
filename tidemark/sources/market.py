"""Readers by kind of feed, for the sources of a configuration, and datagrams as a stream."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidemark.plans.config import Config, Source
from tidemark.sources import binary, fix

COLUMNS = ("kind", "symbol", "side", "price_e4", "quantity", "ts_ns", "order_id")


def read_market(spark: SparkSession, source: Source) -> DataFrame:
    """Orders and trades of a feed in common columns, with its name; only its symbols, if it names some. FIX is text, one
    message a line; the binary feeds are files of length-prefixed frames."""
    source.validate()
    if source.kind == "FIX":
        rows = fix.decode(fix.read_messages(spark, source.path)).where("kind in ('ORDER', 'TRADE')").select("kind", "symbol", "side", "price_e4", "quantity", F.col("tod_ns").alias("ts_ns"), "order_id")
    else:
        frames = binary.read_frames(spark, source.path)
        if source.kind == "ITCH":
            orders, trades = binary.itch_orders(frames), binary.itch_trades(frames)
        else:
            orders = binary.ouch_orders(frames).where("state = 'ACCEPTED'")
            trades = binary.ouch_trades(frames).withColumnRenamed("token", "order_id")
        rows = orders.select(F.lit("ORDER").alias("kind"), *COLUMNS[1:]).unionByName(trades.select(F.lit("TRADE").alias("kind"), *COLUMNS[1:]))
    if source.symbols:
        rows = rows.where(F.col("symbol").isin(list(source.symbols)))
    return rows.withColumn("source", F.lit(source.name))


def read_all(spark: SparkSession, config: Config) -> DataFrame:
    """The feeds of a configuration as one table."""
    out = None
    for source in config.validate().sources:
        rows = read_market(spark, source)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("the configuration names no sources")
    return out


class DatagramReader(SimpleDataSourceStreamReader):
    """Datagrams that have come in since the last batch. They are held until their batch is committed, so a batch can be
    read again while the driver lives; after that they are gone, which is why production feeds go through a log."""

    def __init__(self, host: str, port: int, group: str | None):
        self.host, self.port, self.group = host, port, group
        self.sock: socket.socket | None = None  # opened by the process that reads
        self.held: list[tuple[int, str]] = []
        self.next = 0

    def _open(self) -> socket.socket:
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.sock.bind((self.host, self.port))
            if self.group:
                self.sock.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(self.group) + socket.inet_aton("0.0.0.0"))
            self.sock.setblocking(False)
        return self.sock

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _drain(self) -> None:
        sock = self._open()
        for _ in range(100_000):
            try:
                data = sock.recv(65_535)
            except BlockingIOError:
                return
            self.held.append((self.next, data.decode("utf-8", "replace").rstrip("\n")))
            self.next += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._drain()
        return iter([(n, v) for n, v in self.held if n >= start["n"]]), {"n": self.next}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(n, v) for n, v in self.held if start["n"] <= n < end["n"]])

    def commit(self, end: dict) -> None:
        self.held = [(n, v) for n, v in self.held if n >= end["n"]]


class Datagrams(DataSource):
    """Format `datagrams`: options host (0.0.0.0 if not given), port, and group for multicast."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "n long, value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return DatagramReader(self.options.get("host", "0.0.0.0"), int(self.options["port"]), self.options.get("group"))


def read_datagrams(spark: SparkSession, port: int, host: str = "0.0.0.0", group: str | None = None) -> DataFrame:
    """Datagrams as `value`; FIX lines decode with sources.fix.decode as they do in batch."""
    spark.dataSource.register(Datagrams)
    reader = spark.readStream.format("datagrams").option("host", host).option("port", port)
    return (reader.option("group", group) if group else reader).load()
