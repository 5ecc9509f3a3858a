"""Facts of single operators on small inputs, fits against plain numpy, feeds, streams."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators.asof import asof
from tidemark.plans import features, liquidity, models, strategies, trading
from tidemark.plans.config import Config
from tidemark.sources import binary, fix
from tidemark.sources.adapters import MINUTE, daily_trades, events, orders, quotes, trades
from tidemark.streaming import streams


def ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol long, ts_ns long, trade_seq long, side string, price_e4 long, quantity long, is_hidden boolean")


def quoted(spark, rows):
    return spark.createDataFrame(rows, "symbol long, ts_ns long, quote_seq long, bid_e4 long, ask_e4 long, bid_size long, ask_size long")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("width", [3, 1000])
def test_asof_against_brute_force(spark, forward, equal, width):
    rng = np.random.default_rng(1)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-20, 40, 60), strict=True))]
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 40), rng.integers(-10, 30, 40), strict=True))]
    a, b = spark.createDataFrame(left, "k long, t long, n long"), spark.createDataFrame(right, "k long, t long, m long")
    got = {r.n: r.hit for r in asof(a, b, ["k"], F.col("t"), F.col("t"), ["m"], {"hit": "m"}, width, forward, equal).collect()}
    for k, t, n in left:
        ok = [(x, m) for j, x, m in right if j == k and ((x == t and equal) or (x > t if forward else x < t))]
        want = None if not ok else min(ok)[1] if forward else max(ok)[1]
        assert got[n] == want


def test_tqr_counts(spark):
    t = ticks(spark, [(1, i * 1000, i, "BUY", 1_500_000, 100, False) for i in range(10)] + [(2, 5, 99, "BUY", 1, 1, False)])
    q = quoted(spark, [(1, i * 10, i, 1_499_900, 1_500_100, 100, 100) for i in range(100)] + [(3, 5, 7, 1, 2, 1, 1)])
    got = {r.symbol: r for r in trading.tqr_counts(t, q).collect()}
    assert (got[1].ratio, got[1].n_trades, got[1].n_quotes) == (0.1, 10, 100) and math.isinf(got[2].ratio) and got[3].ratio == 0


def test_tqr_window_forgets(spark):
    old = [(1, i, i, 1_499_900, 1_500_100, 100, 100) for i in range(50)]
    new = [(1, 2000 * MINUTE + i, 100 + i, 1_499_900, 1_500_100, 100, 100) for i in range(10)]
    t = ticks(spark, [(1, 2000 * MINUTE + 50 + i, i, "BUY", 1_500_000, 100, False) for i in range(10)])
    last = trading.tqr_decayed(t, quoted(spark, old + new)).orderBy(F.desc("trade_seq")).first()
    assert (last.n_trades, last.n_quotes) == (10, 10) and abs(last.tqr - 0.5) < 1e-3


def test_slippage_signs(spark):
    q = quoted(spark, [(1, 0, 1, 1_499_900, 1_500_100, 1, 1), (2, 0, 2, 2_999_900, 3_000_100, 1, 1)])
    t = ticks(spark, [(1, 10, 1, "BUY", 1_500_500, 100, False), (2, 10, 2, "SELL", 2_999_000, 100, False)])
    got = {r.symbol: round(r.immediate * 10000, 2) for r in trading.slippage_components(t, q).collect()}
    assert got == {1: 3.33, 2: 3.33}


def test_order_vwap(spark):
    rows = [(1, 1, 1, 1, 10.0, float(k), "BUY", 1_500_000 + d, 250, pd.Timestamp("2024-01-01").date()) for k, d in enumerate((0, 200, 500, 800))]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, side string, price_e4 long, quantity long, day date")
    r = trading.execution_by_order(t).first()
    assert (r.vwap_e4, r.fills, r.quantity) == (1_500_375.0, 4, 1000)


def test_drift_windows_are_null_until_complete(spark):
    t = ticks(spark, [(1, 0, 1, "BUY", 1_000_000, 20_000, False)])
    q = quoted(spark, [(1, m * MINUTE, m, 1_000_000 + 100 * m, 1_000_200 + 100 * m, 1, 1) for m in (5, 10, 45, 70)])
    r = trading.drift_windows(t, q).first()
    assert r.d10 == pytest.approx(0.0011) and r.d30 == pytest.approx(0.0046) and r.d60 == pytest.approx(0.0071) and r.d300 is None and r.d600 is None and not r.permanent


def book(spark, bids, asks):
    level = "array<struct<price_e4:long,quantity:long,order_count:int>>"
    make = lambda qs, s: [(1_000_000 + s * 100 * (i + 1), q, 1) for i, q in enumerate(qs)]
    return spark.createDataFrame([(1, 1, 1, make(bids, -1), make(asks, 1))], f"symbol long, quote_seq long, ts_ns long, bids {level}, asks {level}")


@pytest.mark.parametrize("factor", [1, 2, 3])
def test_book_imbalance(spark, factor):
    r = liquidity.book_levels(book(spark, [1000 * factor * (i + 1) for i in range(10)], [1000 * (i + 1) for i in range(10)])).first()
    want = (factor - 1) / (factor + 1)
    assert r.l1 == pytest.approx(want) and r.depth == pytest.approx(want) and r.weighted == pytest.approx(want) and r.visible == 15000 * (factor + 1)


def test_empty_book(spark):
    assert liquidity.book_levels(book(spark, [0], [0])).first().l1 == 0


def test_anchored_flow_against_a_loop(spark, sf):
    got = liquidity.flow_anchored(trades(spark, sf)).toPandas()
    for _, g in got.sort_values(["ts_ns", "trade_seq"]).groupby("symbol"):
        start = None
        for r in g.itertuples():
            start = r.ts_ns if start is None or r.ts_ns - start > liquidity.FLOW_WINDOW else start
            assert r.window_start == start


def test_icebergs_need_even_refills(spark):
    rows = [(i, 1, 500_000, q, i * MINUTE, s) for i, (q, s) in enumerate([(100, "BUY")] * 4 + [(100, "SELL"), (900, "SELL"), (100, "SELL")])]
    o = spark.createDataFrame(rows, "order_id long, symbol long, price_e4 long, quantity long, ts_ns long, side string")
    got = liquidity.refills(o).collect()
    assert {r.side for r in got} == {"BUY"} and max(r.refill_count for r in got) == 4 and all(r.confidence == 1 for r in got)


def test_exact_buckets_hold_their_volume(spark, sf):
    t = daily_trades(spark, sf)
    got = liquidity.vpin_exact(t).toPandas()
    assert got.volume.sum() == t.agg(F.sum("quantity")).first()[0]
    assert ((got.buy + got.sell) <= got.volume).all() and got.imbalance.between(0, 1).all() and (~got.complete).sum() <= t.select("symbol").distinct().count()


def test_bulk_classification_by_hand():
    buy, sell = liquidity.bulk_classified(np.array([100, 100, 200, 300]), np.array([10.0, 10.0, 5.0, 5.0]))
    assert (buy, sell) == (10.0, 20.0)
    assert liquidity.support_levels(5, 5).tolist() == [5]


def test_pin_recovers_news():
    rng = np.random.default_rng(2)
    news = rng.random(400) < 0.4
    bad = rng.random(400) < 0.5
    buys = rng.poisson(50 + 120 * (news & ~bad)).astype(float)
    sells = rng.poisson(50 + 120 * (news & bad)).astype(float)
    fit = liquidity.fit_pin(buys, sells)
    assert abs(fit["alpha"] - 0.4) < 0.08 and abs(fit["delta"] - 0.5) < 0.12 and 0 < fit["pin"] < 1
    assert fit["pin"] > liquidity.fit_pin(rng.poisson(50, 400).astype(float), rng.poisson(50, 400).astype(float), steps=100)["pin"] - 1


def test_intensity_against_the_sum(spark, sf):
    t = trades(spark, sf).where("symbol = 3")
    e = liquidity.hawkes_events(t).toPandas().sort_values("ts_ns")
    got = liquidity.hawkes_intensity(t).toPandas().set_index("trade_seq")
    for k in range(0, len(e), 7):
        r, past = e.iloc[k], e.iloc[:k]
        w = past.m * liquidity.BETA * np.exp(-liquidity.BETA * (r.ts_ns - past.ts_ns) / MINUTE)
        b, s = w[past.side == "BUY"].sum(), w[past.side != "BUY"].sum()
        assert got.buy[r.trade_seq] == pytest.approx(0.5 + 0.3 * b + 0.1 * s, abs=2e-5)


def test_baum_welch_and_viterbi():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (60, 6)), rng.normal(2.5, 0.3, (60, 6))])
    first, move, means, gamma = models.baum_welch(x)
    assert np.allclose(move.sum(axis=1), 1) and np.allclose(gamma.sum(axis=1), 1) and first.sum() == pytest.approx(1)
    path = models.viterbi(x, first, move, means)
    assert len(set(path[:55]) & set(path[65:])) == 0
    assert np.allclose(models.start_transitions(3).sum(axis=1), 1)  # three states have no pairs to raise


def test_clusters_separate():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.2, (50, 6)) for m in (-6, 0, 6)])
    _, prior, gamma = models.fit_clusters(x, 3)
    assert np.allclose(prior, 1 / 3, atol=0.05) and len({tuple(np.unique(gamma.argmax(axis=1)[k : k + 50])) for k in (0, 50, 100)}) == 3


def test_hurst_bounds():
    rng = np.random.default_rng(6)
    assert 0 <= features.hurst(rng.normal(size=100)) <= 1 and features.hurst(np.zeros(100)) == 0.5 and features.hurst(np.zeros(2)) == 0.5


def test_feature_vector_width(spark, sf):
    rows = features.feature_vector(trades(spark, sf).where("symbol = 1"), quotes(spark, sf)).select("features").collect()
    assert rows and all(len(r.features) == 128 and all(map(math.isfinite, r.features)) for r in rows)


def test_elastic_net_fits(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.01, 400)
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "vec_id long, x array<double>, y double")
    w = {r.dim: r for r in models.elastic_net_report(rows).collect()}
    assert abs(w[0].weight - 3) < 0.1 and abs(w[1].weight + 2) < 0.1 and abs(w[3].weight) < 0.05


def test_schedules_sum_up(spark):
    o = spark.createDataFrame([(1, 50_000, 0.5), (2, 13, 1.0), (3, 999_999, 0.2)], "order_id long, quantity long, urgency double")
    for plan in (strategies.schedule_vwap(o), strategies.schedule_vwap(o, normalised=True), strategies.schedule_twap(o), strategies.schedule_shortfall(o)):
        assert {r.order_id: r.s for r in plan.groupBy("order_id").agg(F.sum("planned").alias("s")).collect()} == {1: 50_000, 2: 13, 3: 999_999}
    twap = [r.planned for r in strategies.schedule_twap(o).where("order_id = 2").orderBy("bucket").collect()]
    assert twap == [2, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    front = [r.planned for r in strategies.schedule_shortfall(o).where("order_id = 1").orderBy("bucket").collect()]
    assert front[1] > front[5]


def test_allocation_sums_up(spark, sf):
    o = spark.createDataFrame([(1, 1000), (2, 7), (3, 123_456)], "order_id long, quantity long")
    got = strategies.allocation(o, strategies.venues(spark, sf)).groupBy("order_id").agg(F.sum("allocated").alias("q"), F.count("*").alias("n"), F.max("allocated").alias("m")).collect()
    assert {r.order_id: r.q for r in got} == {1: 1000, 2: 7, 3: 123_456} and all(r.n <= 5 for r in got)


def test_fix_cases(spark):
    soh = "\x01"
    good = {35: "D", 56: "150=9", 11: "ORD77", 55: "AAPL", 54: "1", 38: "100", 44: "150.2512", 40: "P", 52: "20240102-09:30:00.123"}
    text = lambda d: soh.join(f"{k}={v}" for k, v in d.items()) + soh
    bad = [{**good, 38: "x"}, {k: v for k, v in good.items() if k != 55}, {**good, 35: "Z"}, {}, {**good, 35: "8", 150: "0", 37: "1", 31: "1", 32: "1"}]
    rows = spark.createDataFrame([(text(good),), *((text(b),) for b in bad), ("\x00garbage",), ("35=D",), (None,)], "value string")
    got = fix.decode(rows).collect()
    first = got[0]
    assert (first.kind, first.symbol, first.side, first.price_e4, first.quantity, first.order_type, first.order_id_str) == ("ORDER", "AAPL", "BUY", 1_502_512, 100, "PEGGED", "ORD77")
    assert first.tod_ns == (9 * 3600 + 30 * 60) * 10**9 + 123 * 10**6 and all(r.kind is None for r in got[1:])


def test_frames_from_files(spark, sf, tmp_path):
    frames = binary.write_itch(events(spark, sf)).orderBy("seq").collect()
    data = b"".join(bytes(r.frame) for r in frames)
    (tmp_path / "a.itch").write_bytes(data)
    (tmp_path / "b.itch").write_bytes(data[:-1] + b"")
    got = binary.read_frames(spark, str(tmp_path))
    counts = {r.path[-6:]: r.n for r in got.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a.itch": len(frames), "b.itch": len(frames) - 1}
    one = got.where("path like '%a.itch'")
    assert binary.itch_trades(one).count() == binary.itch_trades(binary.write_itch(events(spark, sf))).count()
    assert {r.type for r in binary.itch_types(one).collect()} == {"A", "E", "P", "X"}
    assert {len(bytes(r.frame)) for r in frames} == {38, 33, 25, 46}


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.to_price(F.lit(1.23456)).alias("a"), scalar.to_price(F.lit(-1.23456)).alias("b"), scalar.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("c"), scalar.gelu(F.lit(0.0)).alias("d"),
        scalar.price_bucket(F.lit(100), F.lit(200)).alias("e"), scalar.price_bucket(F.lit(900), F.lit(200)).alias("f"), scalar.power_kernel(F.lit(0.0)).alias("g"), scalar.sigmoid(F.lit(0.0)).alias("h"), scalar.exponential_kernel(2.0, F.lit(0.0)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (12345, -12345, [0.5, 0.5], 0, 0, 99, 1, 0.5, 2)


def test_config():
    c = Config.of({"sources": [{"name": "a", "kind": "FIX", "path": "/x", "symbols": ["B", "A"]}, {"name": "b", "kind": "ITCH", "path": "/y", "symbols": ["A"]}]})
    assert c.symbols() == ["B", "A"]
    for bad in ({"sources": [{"name": "a", "kind": "SQL", "path": "x"}]}, {"detectors": {"vpin_bucket": 0}}):
        with pytest.raises(ValueError):
            Config.of(bad)


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    for name, rows in (("trades", trades(spark, sf)), ("quotes", quotes(spark, sf)), ("orders", orders(spark, sf))):
        rows.repartitionByRange(4, "ts_ns").sortWithinPartitions("ts_ns").write.parquet(str(root / name))
        for k, p in enumerate(sorted((root / name).glob("part-*"))):
            os.utime(p, (1_700_000_000 + 10 * k,) * 2)  # files are read in the order of their times
    return root


def drain(rows, name, mode="append"):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.progress(q)["batch"] >= 0
    return rows.sparkSession.table(name)


def stream(spark, feed, name, frame, files=1):
    return streams.read_stream(spark, str(feed / name), frame.schema.simpleString()[7:-1].replace(":", " "), files)


def test_stream_bars_equal_batch(spark, sf, feed):
    t = trades(spark, sf)
    got = drain(streams.bars(stream(spark, feed, "trades", t), "1 hour", "1000 days"), "bars", "complete").selectExpr("symbol", "unix_micros(start) div 3600000000 AS bar", "open", "high", "low", "close", "volume", "trades")
    want = trading.bars(t, 60 * MINUTE)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_windows_and_sessions(spark, sf, feed):
    t, q = stream(spark, feed, "trades", trades(spark, sf)), stream(spark, feed, "quotes", quotes(spark, sf))
    assert drain(streams.tqr(t, q, "2 hours", "1 hour", "1000 days"), "tqr", "complete").count() > 0
    o = stream(spark, feed, "orders", orders(spark, sf))
    assert drain(streams.sessions(o, "1000 minutes"), "sessions").count() > 0
    assert drain(streams.once(stream(spark, feed, "trades", trades(spark, sf)), "trade_seq", "1000 days").select("trade_seq"), "once").count() == trades(spark, sf).count()


def test_stream_state_equals_batch(spark, sf, feed):
    t = trades(spark, sf)
    got = drain(streams.intensity(stream(spark, feed, "trades", t)), "intensity").selectExpr("trade_seq", "round(buy, 4) AS buy").toPandas().set_index("trade_seq").buy
    want = liquidity.hawkes_intensity(t).toPandas().set_index("trade_seq").buy
    assert len(got) == len(want) and (got - want.reindex(got.index)).abs().max() < 1e-4
    buckets = drain(streams.volume_buckets(stream(spark, feed, "trades", t), 3000), "buckets").toPandas()
    assert (buckets.volume >= 3000).all() and buckets.imbalance.between(0, 1).all()


def test_stream_sink_writes_once(spark, sf, feed, tmp_path):
    rows = stream(spark, feed, "trades", trades(spark, sf), 2).select("symbol", "trade_seq")
    for _ in range(2):
        streams.push(rows, streams.json_sink(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == trades(spark, sf).count()
    assert "tidemark_batch 3" in streams.exposition({"batch": 3.0})


def test_generated_patterns_are_found(spark):
    from tidemark.sources.generator import generate

    made = generate(spark, 3000, 3)
    assert made["labels"].count() == 12
    assert {r.symbol for r in liquidity.refills(made["orders"]).where("visible = 1000 and refill_count >= 10").collect()} == {0, 1, 2}
    assert made["trades"].where("is_hidden and quantity >= 10000").select("symbol").distinct().count() == 3
    share = made["quotes"].count() / 3000
    assert 0.65 < share < 0.76
    assert generate(spark, 3000, 3)["trades"].exceptAll(made["trades"]).count() == 0


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], float(2 * (i % 7))) for i in range(200)], "vec_id long, x array<double>, y double")
    model = models.fit_elastic_net(rows)
    models.save_model(model, str(tmp_path / "m"), spark)
    intercept, weights = models.load_model(spark, str(tmp_path / "m"))
    assert intercept == model.intercept and weights == list(model.coefficients.toArray())


def test_socket_lines_decode(spark):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"35=S\x0155=AB\x01132=1.5\x01133=1.6\x01\n")
        threading.Event().wait(8)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    rows = fix.decode(streams.read_socket(spark, "127.0.0.1", server.getsockname()[1]))
    q = rows.select("kind", "symbol", "bid_e4").writeStream.format("memory").queryName("lines").start()
    try:
        for _ in range(40):
            if spark.table("lines").count():
                break
            threading.Event().wait(0.3)
        assert [tuple(r) for r in spark.table("lines").collect()] == [("QUOTE", "AB", 15000)]
    finally:
        q.stop()
        server.close()


def test_flow_does_not_look_ahead(spark):
    b = book(spark, [100], [100]).withColumn("ts_ns", F.lit(5 * MINUTE))
    past, later = (1, 4 * MINUTE, 1, "BUY", 1_000_000, 300, True), (1, 6 * MINUTE, 2, "BUY", 1_000_000, 5000, False)
    got = [liquidity.flow_ratio(b, ticks(spark, rows)).first().hidden_ratio for rows in ([past], [past, later], [later])]
    assert got == [3.0, 3.0, 0.0]


def test_quotes_of_each_symbol(spark, sf):
    t = ticks(spark, [(1, 1, 1, "BUY", 1_000_000, 500_000, False), (2, 1, 2, "SELL", 50_000, 500_000, False)])
    rows = strategies.market_maker_quotes(strategies.venues(spark, sf), t).collect()
    assert {r.symbol for r in rows} == {1, 2}
    for r in rows:
        middle = (r.bid + r.ask) / 2
        assert (middle < 1_000_000 and abs(middle / 1_000_000 - 1) < 0.01) if r.symbol == 1 else (middle > 50_000 and abs(middle / 50_000 - 1) < 0.01)


def test_every_supplier_counts(spark, sf):
    assert strategies.venues(spark, sf).count() == 10
    many = spark.range(1000).select(F.col("id").alias("s_suppkey"))
    many.createOrReplaceTempView("many")
    from tidemark.sources import adapters

    table, adapters.table = adapters.table, lambda s, f, n: many
    try:
        v = adapters.venues(spark, sf).toPandas()
    finally:
        adapters.table = table
    assert len(v) == adapters.VENUES and v.avg_spread_bps.between(1, 7).all() and v.avg_spread_bps.nunique() > 5


def test_running_limit_of_an_account(spark):
    rows = [(i, 15_000, 0.5, i % 2) for i in range(16)] + [(16, 30_000, 0.5, 0)]
    got = {r.order_id: r.verdict for r in strategies.risk_checks(spark.createDataFrame(rows, "order_id long, quantity long, urgency double, account long")).collect()}
    assert [got[i] for i in range(17)] == ["OK"] * 12 + ["POSITION_LIMIT"] * 4 + ["ORDER_SIZE"]


def test_curve_is_followed(spark):
    o = spark.createDataFrame([(1, 50_000, 0.5)], "order_id long, quantity long, urgency double")
    assert [r.planned for r in strategies.schedule_vwap(o).orderBy("bucket").collect()] == [round(50_000 * c) for c in strategies.CURVE]


def test_gates_are_those_of_the_defaults(spark, sf):
    assert liquidity.vpin_anomaly(daily_trades(spark, sf)).count() == 0
    t = ticks(spark, [(1, i * MINUTE, i, "BUY", 1_000_000, 100, False) for i in range(120)] + [(1, 200 * MINUTE, 500, "BUY", 1_000_000, 90, False), (1, 201 * MINUTE, 501, "SELL", 1_000_000, 10_000, False)])
    assert {r.trade_seq for r in trading.large_trades(t).collect()} >= {501} and 500 not in {r.trade_seq for r in trading.large_trades(t).collect()}
    few = ticks(spark, [(1, i * MINUTE, i, "BUY", 1_000_000, 100, False) for i in range(10)])
    assert trading.large_trades(few).count() == 0 and liquidity.hawkes_anomaly(few).count() == 0


def test_prices_of_zero_pass(spark):
    t = ticks(spark, [(1, i * MINUTE, i, "BUY" if i % 3 else "SELL", 0 if i % 4 == 0 else 1000 + i, 100, False) for i in range(40)])
    q = quoted(spark, [(1, i * MINUTE, i, -50 if i % 4 == 0 else 950, 50 if i % 4 == 0 else 1050, 100, 100) for i in range(40)])
    for rows in (trading.slippage_metrics(t, q), trading.drift_windows(t, q), features.price_features(t), features.stat_features(t), features.micro_features(t, q), models.hmm_observations(t, q), models.cluster_features(t, q), strategies.value_at_risk(t), strategies.market_conditions(t, q), liquidity.heatmap_cells(t), features.hurst_features(t)):
        rows.collect()
    assert trading.slippage_metrics(t, q).count() == 40


def test_ten_detectors_in_one_table(spark):
    from tidemark.plans import feeds

    m = feeds.Market.of(spark, "/root/testdata/sf0.01").only([1, 2])
    found = feeds.anomalies([*feeds.exact_findings(m, feeds.GATES), *feeds.fitted_findings(m, feeds.GATES)], feeds.GATES)
    rows = found.toPandas()
    assert set(rows.symbol) <= {1, 2} and len({"TQR", "HAWKES", "BOOK", "PIN_INTRADAY"} & set(rows.detector)) >= 3 and set(rows.detector) <= set(feeds.LABELS)
    slots = rows.assign(slot=rows.ts_ns // (100 * MINUTE)).groupby(["symbol", "detector", "type", "slot"]).size()
    assert (slots == 1).all() and rows.description.str.contains("confidence").all()


def test_hurst_rows_equal_a_fit(spark, sf):
    """Against one window at a time with a least-squares fit."""

    def plain(x):
        points = []
        for n in (4, 8, 16):
            if len(x) < n:
                break
            parts = x[: len(x) // n * n].reshape(-1, n)
            walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
            sd = parts.std(axis=1)
            if (sd > 1e-12).any():
                points.append((np.log(n), np.log(((walk.max(axis=1) - walk.min(axis=1))[sd > 1e-12] / sd[sd > 1e-12]).mean())))
        return float(np.clip(np.polyfit(*zip(*points, strict=True), 1)[0], 0, 1)) if len(points) > 1 else 0.5

    t = trades(spark, sf).toPandas().sort_values(["ts_ns", "trade_seq"])
    t.loc[t.trade_seq % 97 == 5, "price_e4"] = 0
    got = features.hurst_features(spark.createDataFrame(t), n=30).toPandas().set_index("trade_seq")
    for _, g in t.groupby("symbol"):
        with np.errstate(divide="ignore"):
            r = np.diff(np.log(np.where(g.price_e4 > 0, g.price_e4, np.nan)))
        for k, seq in enumerate(g.trade_seq):
            x = r[max(0, k - 30) : k]
            x = x[~np.isnan(x)]
            d = np.abs(np.diff(x))
            ok = (d[:-1] > 1e-12) & (d[1:] > 1e-12) if len(d) > 1 else np.zeros(0, bool)
            assert got.hurst[seq] == pytest.approx(plain(x), abs=1e-9)
            assert got.lyapunov[seq] == pytest.approx(np.log(d[1:][ok] / d[:-1][ok]).mean() if ok.any() else 0.0, abs=1e-9)


@pytest.mark.parametrize("width", [7, 1000])
def test_lookups_in_one_pass_equal_single_ones(spark, width):
    from tidemark.operators.asof import Lookup, asof_many

    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-20, 60, 60), strict=True))], "k long, t long, n long")
    b = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 40), rng.integers(-10, 50, 40), strict=True))], "k long, t long, m long")
    cases = {"x": (0, False, True), "y": (-9, False, False), "z": (6, True, True), "w": (2, True, False)}
    got = asof_many(a, b, ["k"], ["n"], [Lookup(c, F.col("t") + d, f, e) for c, (d, f, e) in cases.items()], F.col("t"), ["m"], ["m"], width).collect()
    assert len(got) == 60
    for c, (d, f, e) in cases.items():
        want = {r.n: r.hit for r in asof(a, b, ["k"], F.col("t") + d, F.col("t"), ["m"], {"hit": "m"}, width, f, e).collect()}
        assert {r.n: r[c].m if r[c] else None for r in got} == want


def test_blocked_windows_equal_plain_ones(spark):
    from tidemark.functions.scalar import span_back
    from tidemark.operators.blocks import blocked

    rng = np.random.default_rng(4)
    t = spark.createDataFrame([(int(k), int(x), i) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-500, 500, 300), strict=True))], "k long, t long, n long")
    rows, w, age = blocked(t, ["k"], "t", 70)
    got = rows.select("n", "_own", F.sum("n").over(w).alias("s"), F.count("*").over(w).alias("c"), age.alias("age")).where("_own")
    want = t.select("n", F.sum("n").over(span_back(70, "k", order="t")).alias("s"), F.count("*").over(span_back(70, "k", order="t")).alias("c"))
    assert got.select("n", "s", "c").exceptAll(want).count() == 0 and got.where("age < 0 or age >= 70").count() == 0 and got.count() == 300


@pytest.mark.parametrize("least", [0, 1])
def test_blocked_sums_equal_plain_ones(spark, least):
    from tidemark.operators.blocks import blocked, blocked_sum

    rows = [(k % 2, k, k * k % 613, None if k % 5 == 0 else k / 7) for k in range(400)]  # with equal times and nulls
    t = spark.createDataFrame(rows, "k long, id long, t long, x double")
    twice, _, _ = blocked(t, ["k"], "t", 70)
    got = {r.id: r.s for r in twice.select("id", "_own", blocked_sum(F.col("x"), ["k"], "t", 70, least).alias("s")).where("_own").collect()}
    for key, i, at, _ in rows:
        inside = [x for k2, _, t2, x in rows if k2 == key and at - 70 <= t2 <= at - least and x is not None]
        assert got[i] == pytest.approx(sum(inside)) if inside else got[i] is None
    assert len(got) == 400


@pytest.mark.parametrize("name", ["tqr_anomaly", "reactions", "heatmap_anomalies", "book_flow_ratio", "hawkes_intensity", "hawkes_grid"])
def test_no_frame_of_time_is_summed_anew_at_every_row(spark, sf, name):
    import re

    from tidemark.plans import registry

    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"RangeFrame, -\d+", plan)


def test_large_threshold_gathers_no_list_for_every_row(spark):
    rng = np.random.default_rng(7)
    times, sizes = np.sort(rng.integers(0, 300, 500)), rng.integers(1, 60, 500)  # several trades at a time
    rows = [(k % 2, int(ts), k, "BUY", 1, None if k % 50 == 0 else int(v), False) for k, (ts, v) in enumerate(zip(times, sizes, strict=True))]
    found = trading.large_threshold(ticks(spark, rows), window=40)
    got = {r.trade_seq: (r.n, r.p95) for r in found.collect()}
    for symbol, ts, k, _, _, _, _ in rows:
        inside = sorted(r[5] for r in rows if r[0] == symbol and ts - 40 <= r[1] <= ts and r[5] is not None)
        assert got[k] == (len(inside), inside[min(len(inside) - 1, math.floor(len(inside) * 0.95))] if inside else None)
    assert len(got) == 500 and "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
