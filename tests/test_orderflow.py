"""Life of orders, patterns of errors, feeds of a configuration, datagrams, alerts of streams."""

import socket

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import feeds, liquidity, models, orderflow
from tidemark.plans.config import Config
from tidemark.sources import binary, fix
from tidemark.sources.adapters import MINUTE, events, quotes, trades
from tidemark.sources.market import read_all, read_datagrams
from tidemark.streaming import streams

from .test_engine import drain, feed, stream, ticks  # noqa: F401

EVENTS = "order_id long, event_no int, symbol long, venue int, side string, price_e4 long, quantity long, ts_ns long, kind string"


def test_life_of_an_order(spark):
    steps = [("NEW", 500, 10_000), ("EXEC", 200, 10_000), ("REPLACE", 400, 10_100), ("EXEC", 100, 10_100), ("CANCEL", 300, 10_100)]
    rows = [(1, k, 1, 1, "BUY", p, q, k * MINUTE // 10, kind) for k, (kind, q, p) in enumerate(steps)] + [(2, 9, 1, 1, "BUY", 1, 5, 3, "EXEC")]
    got = [r for r in orderflow.order_states(spark.createDataFrame(rows, EVENTS)).orderBy("order_id", "event_no").collect() if r.order_id == 1]
    assert [(r.remaining, r.state, r.price_e4, r.executions) for r in got] == [(500, "LIVE", 10_000, 0), (300, "LIVE", 10_000, 1), (400, "LIVE", 10_100, 1), (300, "LIVE", 10_100, 2), (0, "CANCELLED", 10_100, 2)]
    assert [r.fast for r in got] == [False, True, True, True, True] and [r.potential_iceberg for r in got][-1]
    met = orderflow.executions_of_orders(spark.createDataFrame(rows, EVENTS)).collect()
    assert {r.order_id for r in met} == {1}  # executions of unknown orders are dropped


def test_waits_by_venue(spark):
    rows = [(1, 0, 1, 7, "BUY", 1, 100, 0, "NEW"), (1, 1, 1, 7, "BUY", 1, 100, MINUTE, "EXEC"), (2, 0, 1, 7, "BUY", 1, 100, 0, "NEW"), (3, 0, 1, 7, "BUY", 1, 100, 0, "NEW"), (3, 1, 1, 7, "BUY", 1, 100, 3 * MINUTE, "EXEC")]
    e = spark.createDataFrame(rows, EVENTS)
    q = orderflow.queue_positions(e).first()
    assert q.fills == 2 and q.position == pytest.approx((2 - 2.718281828**-1 - 2.718281828**-3) / 2, abs=1e-5)
    assert tuple(orderflow.unfilled_orders(e).first()) == (7, 3, 2)


def test_resets_forget(spark):
    t = ticks(spark, [(s, k, 10 * s + k, "BUY", 1, 1, False) for s in (1, 2) for k in range(5)])
    r = spark.createDataFrame([(1, 2), (1, 1)], "symbol long, reset_ns long")
    assert sorted(tuple(x) for x in orderflow.after_reset(t, r).select("symbol", "ts_ns").collect()) == [(1, 3), (1, 4), *[(2, k) for k in range(5)]]


@pytest.mark.parametrize(
    ("z", "steps", "parts", "want"),
    [(1.0, [9.0] * 4, [1.0] * 4, "NORMAL"), (4.0, [9.0] * 4, [1.0] * 4, "REGIME_CHANGE"), (4.0, [9.0, 0, 9, 0, 9, 0, 0, 0], [1.0] * 8, "CYCLIC_ANOMALY"), (6.0, [9.0, 0, 0, 0], [1.0] * 4, "SEQUENCE_NOVELTY"), (4.0, [9.0, 0, 0, 0], [9.0, 0.1, 0.1, 0.1], "CORRELATION_BREAK"), (4.0, [9.0, 0, 0, 0], [1.0] * 4, "TREND_BREAK")],
)
def test_pattern_classes(spark, z, steps, parts, want):
    row = spark.createDataFrame([(z, [float(x) for x in steps], parts)], "z double, steps array<double>, parts array<double>")
    assert row.select(models.pattern_class(F.col("z"), F.col("steps"), F.col("parts"), F.lit(5.0)).alias("p")).first().p == want


def test_frames_are_little_endian(spark):
    raw = bytes(spark.range(1).select(orderflow.binary_frame(2, F.lit(258), F.lit(2**40 + 5), F.lit("aé")).alias("f")).first().f)
    assert raw == bytes([2]) + (258).to_bytes(4, "little") + (2**40 + 5).to_bytes(8, "little") + (3).to_bytes(4, "little") + "aé".encode()


def test_findings_mark_all_cells_of_their_time(spark):
    t = ticks(spark, [(1, k * 30 * 60 * MINUTE, k, "BUY", 1_000_000 + 20_000 * (k % 3), 100, False) for k in range(8)])
    found = t.where("trade_seq = 7").select("symbol", "ts_ns")
    got = {(r.age, r.cell): r.anomalies for r in orderflow.heatmap_anomalies(t, found).collect()}
    cells = {(r.age, r.cell) for r in liquidity.heatmap_cells(t).collect()}
    assert set(got) == cells and {k for k, v in got.items() if v} == {c for c in cells if c[0] == 0}


def test_feeds_of_a_configuration(spark, sf, tmp_path):
    e = events(spark, sf)
    fix.write_events(e).select("value").coalesce(1).write.text(str(tmp_path / "fix"))
    (tmp_path / "itch").mkdir()
    (tmp_path / "itch" / "a").write_bytes(b"".join(bytes(r.frame) for r in binary.write_itch(e).orderBy("seq").collect()))
    (tmp_path / "ouch").mkdir()
    (tmp_path / "ouch" / "a").write_bytes(b"".join(bytes(r.frame) for r in binary.write_ouch(e).orderBy("seq").collect()))
    config = Config.of({"sources": [{"name": k, "kind": k.upper(), "path": str(tmp_path / k), "symbols": ["SYM1", "SYM2"]} for k in ("fix", "itch", "ouch")]})
    got = read_all(spark, config).groupBy("source", "kind").agg(F.count("*").alias("n"), F.min("symbol").alias("a"), F.max("symbol").alias("b")).collect()
    assert {(r.source, r.kind) for r in got} == {(s, k) for s in ("fix", "itch", "ouch") for k in ("ORDER", "TRADE")} and all((r.a, r.b) == ("SYM1", "SYM2") for r in got)
    want = e.where("event_type = 'signup' and symbol in (1, 2)").count()
    assert all(r.n == want for r in got if r.kind == "ORDER")
    with pytest.raises(ValueError):
        read_all(spark, Config())


def test_datagrams_decode(spark):
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    rows = fix.decode(read_datagrams(spark, port, "127.0.0.1")).select("kind", "symbol", "bid_e4")
    q = rows.writeStream.format("memory").queryName("grams").start()
    try:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        for k in range(60):
            out.sendto(b"35=S\x0155=AB\x01132=1.5\x01133=1.6\x01\n", ("127.0.0.1", port))
            if q.exception():
                raise q.exception()
            q.awaitTermination(0.5)
            if spark.table("grams").count():
                break
        assert {tuple(r) for r in spark.table("grams").collect()} == {("QUOTE", "AB", 15000)}
    finally:
        q.stop()


def test_stream_alerts_reach_a_sink(spark, sf, feed, tmp_path):  # noqa: F811
    t, q = trades(spark, sf), quotes(spark, sf)
    own = lambda: (stream(spark, feed, "trades", t, 100), stream(spark, feed, "quotes", q, 100))
    found = {
        "tqr": streams.tqr_alerts(*own(), limit=1.5, width="2 hours", late="1000 days").select("symbol", "ts_ns", "detector", "type", "confidence", "magnitude"),
        "hawkes": streams.intensity_alerts(own()[0], 0.33), "toxic": streams.toxic_alerts(own()[0], 2000, keep=5, least=3, sigmas=0.2), "slippage": streams.slippage_alerts(*own()),
    }
    for name, rows in found.items():
        streams.push(rows, streams.json_sink(str(tmp_path / name)), str(tmp_path / f"{name}-state"), "complete" if name == "tqr" else "append").awaitTermination()
        got = spark.read.json(str(tmp_path / name))
        assert got.count() > 0 and set(got.columns) >= {"symbol", "ts_ns", "detector", "type", "confidence", "magnitude"}, name
    total = liquidity.hawkes_intensity(t).where("buy + sell > 0.99").count()
    assert spark.read.json(str(tmp_path / "hawkes")).count() == total


def test_thresholds_can_be_replaced():
    from dataclasses import replace

    d = replace(feeds.GATES, hawkes_threshold=5.0)
    d.validate()
    assert d.hawkes_threshold == 5.0 and feeds.GATES.hawkes_threshold != 5.0
    with pytest.raises(ValueError):
        replace(d, pin_period="year").validate()


def test_a_gradient_step_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(50, 4)), [0.5, -1.0, 0.0, 2.0]
    y = x @ np.array([1.0, -1.0, 0.5, 2.0])
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "vec_id long, x array<double>, y double")
    got = [r.weight for r in models.gradient_step(rows, w, 0.2).orderBy("dim").collect()]
    e = x @ np.array(w) + 0.2 - y
    assert np.allclose(got, np.array(w) - 0.01 * ((x * e[:, None]).mean(axis=0) + 0.001 * np.array(w)), atol=1e-7)
    cv = {r.alpha: r for r in models.cross_validate(rows, (0.001, 1.0)).collect()}
    assert cv[0.001].rmse < cv[1.0].rmse and cv[1.0].held_out == 50


def test_spans_at_an_exact_half_round_as_in_sql(spark, tmp_path):
    # of two trades by each symbol, with spans of whole and a half of a millionth of a minute whose binary product falls short
    spans = [us for us in range(20_010, 200_000, 60) if int(us * 1000 / 6e10 * 1e6 + 0.5) != (us + 30) // 60][:10]
    assert len(spans) == 10
    con = duckdb.connect()
    rows = ", ".join(f"({2 * s + j}, make_timestamp({1_704_067_200_000_000 + j * us}), {s}, 'click', 10.0, '{{\"k\": 0}}')" for s, us in enumerate(spans) for j in (0, 1))
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)")
    con.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM events) TO '{tmp_path}/events.parquet'")
    want = {r[0]: r[1] for r in con.sql(f"SELECT trade_seq, pov FROM ({orderflow.SQL['slice_quantities']})").fetchall()}
    got = {r.trade_seq: r.pov for r in orderflow.QUERIES["slice_quantities"](spark, str(tmp_path)).collect()}
    assert got == want and max(want.values()) < orderflow.LARGEST_SIZE
