"""Fits and models: regimes, clusters, elastic nets, linear scores, sequence models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio, rows_back, up_to_now
from tidemark.operators.asof import asof
from tidemark.sources.adapters import HOUR, MINUTE, TICKS_SQL, quotes, table, trades

DAY = 24 * HOUR
ORDER = ("ts_ns", "trade_seq")

# -- observations and regimes -----------------------------------------------------------------------------------------

STATES, STEPS, TOLERANCE, ASYMMETRY = 5, 100, 1e-4, 0.2
PAIRS = ((1, 3), (3, 1), (2, 4), (4, 2))
OBSERVED = ("volume", "change", "imbalance", "trade_rate", "size", "quote_rate")


def hmm_observations(t: DataFrame, q: DataFrame, n: int = 50) -> DataFrame:
    """At each trade, over the last n: size against its running mean, price change, book imbalance, rates (in minutes)."""
    w, ever = rows_back(n, "symbol", order=ORDER), up_to_now("symbol", order=ORDER)
    rows = asof(t, q.withColumn("nq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns", "quote_seq")).cast("long")).withColumn("q0", F.min("ts_ns").over(Window.partitionBy("symbol"))), ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], {c: c for c in ("bid_size", "ask_size", "nq", "q0")}, DAY)
    minutes = lambda ns: ns / float(MINUTE)
    size, first = F.avg("quantity").over(w), F.first("price_e4").over(w)
    span = F.max("ts_ns").over(w) - F.min("ts_ns").over(w)
    buys = F.sum(F.when(F.col("side") == "BUY", 1).otherwise(-1)).over(w)
    rows = rows.select(
        "symbol", *ORDER, (size / F.avg("quantity").over(ever)).alias("volume"), F.coalesce(ratio(F.col("price_e4") - first, first), F.lit(0.0)).alias("change"), F.coalesce((F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size")), F.lit(0.0)).alias("imbalance"),
        F.coalesce(ratio(F.count("*").over(w), minutes(span)), F.lit(1.0)).alias("trade_rate"), (size / 1000).alias("size"), F.coalesce(ratio(F.col("nq"), minutes(F.col("ts_ns") - F.col("q0"))), F.lit(1.0)).alias("quote_rate"),
        F.when(buys > 0, "BUY").otherwise("SELL").alias("net"), F.row_number().over(Window.partitionBy("symbol").orderBy(*ORDER)).alias("k"),
    )
    return rows.where("k >= 10").select("symbol", "trade_seq", "ts_ns", *[F.round(c, 6).alias(c) for c in OBSERVED], "net")


def start_transitions(n: int = STATES) -> np.ndarray:
    """Staying is likely; buying states lead to each other, and so do selling ones."""
    out = np.full((n, n), 0.1)
    np.fill_diagonal(out, 0.6)
    for i, j in PAIRS:
        if i < n and j < n:
            out[i, j] = 0.15 * (1 + ASYMMETRY)
    return out / out.sum(axis=1, keepdims=True)


def densities(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """exp(-|x - mean|^2 / 2), with the exponent held above -50: spherical and not normalised."""
    d = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    return np.exp(np.maximum(-50.0, -0.5 * d))


def baum_welch(x: np.ndarray, n: int = STATES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Initial probabilities, transitions, means and posteriors of a model whose covariances stay the identity."""
    first, move = np.full(n, 1 / n), start_transitions(n)
    means = np.zeros((n, x.shape[1]))
    means[:, 0] = 0.5 + 0.5 * np.arange(n)
    means[:, 1] = np.where(np.arange(n) % 2 == 0, 0.01, -0.01)
    last, size = -np.inf, len(x)
    gamma = np.full((size, n), 1 / n)
    for _ in range(steps):
        e = densities(x, means)
        a, b, scale = np.empty((size, n)), np.ones((size, n)), np.empty(size)
        a[0] = first * e[0]
        for k in range(size):
            if k:
                a[k] = (a[k - 1] @ move) * e[k]
            scale[k] = a[k].sum()
            a[k] /= scale[k]
        for k in range(size - 2, -1, -1):
            b[k] = move @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        gamma = a * b
        gamma /= gamma.sum(axis=1, keepdims=True)
        total = np.log(scale).sum()
        if abs(total - last) < TOLERANCE:
            break
        last = total
        xi = a[:-1, :, None] * move[None] * (e[1:] * b[1:])[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        first = gamma[0]
        move = xi.sum(axis=0) / np.maximum(gamma[:-1].sum(axis=0), 1e-300)[:, None]
        for i, j in PAIRS:
            if i < n and j < n:
                move[i, j] *= 1 + ASYMMETRY
        move /= np.maximum(move.sum(axis=1, keepdims=True), 1e-300)
        means = (gamma.T @ x) / np.maximum(gamma.sum(axis=0), 1e-300)[:, None]
    return first, move, means, gamma


def viterbi(x: np.ndarray, first: np.ndarray, move: np.ndarray, means: np.ndarray) -> np.ndarray:
    e = np.log(densities(x, means))
    logs = np.log(np.maximum(move, 1e-300))
    best, back = np.log(np.maximum(first, 1e-300)) + e[0], []
    for row in e[1:]:
        step = best[:, None] + logs
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def regime(states: np.ndarray, obs: pd.DataFrame) -> str:
    """Rules over the last twenty observations, in order: dark trading, pressure, accumulation or distribution, normal."""
    n = min(20, len(states))
    top = int(np.bincount(states[-n:], minlength=STATES).argmax())
    tail = obs.iloc[-n:]
    bias = int((tail.net == "BUY").sum() * 2 - n)
    volume, change, imbalance = tail.volume.mean(), tail.change.mean(), tail.imbalance.mean()
    if abs(change) < 0.001 and abs(bias) > n * 0.7 and 0.8 < volume < 2.0:
        return "DARK_POOL_BUY" if bias > 0 else "DARK_POOL_SELL"
    if top == 3 or (imbalance > 0.5 and bias > n * 0.6):
        return "BUYING_PRESSURE"
    if top == 4 or (imbalance < -0.5 and bias < -n * 0.6):
        return "SELLING_PRESSURE"
    if top == 1 or (volume > 1.2 and bias > 0):
        return "ACCUMULATION"
    if top == 2 or (volume > 1.2 and bias < 0):
        return "DISTRIBUTION"
    return "NORMAL"


def hmm_regimes(t: DataFrame, q: DataFrame, keep: int = 500) -> DataFrame:
    """The regime of each symbol after its last observations, with the decoded path's length of stay and the transitions."""
    obs = hmm_observations(t, q)
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("trade_seq")))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(ORDER))
        if len(g) < 50:
            return pd.DataFrame(columns=["symbol", "regime", "state", "probability", "streak", "transitions", "ts_ns", "avg_volume"])
        x = g[list(OBSERVED)].to_numpy(float)
        first, move, means, gamma = baum_welch(x)
        path = viterbi(x, first, move, means)
        changed = np.flatnonzero(path != path[-1])
        streak = len(path) - 1 - (changed[-1] if len(changed) else -1)
        return pd.DataFrame([{"symbol": g.symbol.iloc[0], "regime": regime(path, g), "state": int(path[-1]), "probability": float(gamma[-1, path[-1]]), "streak": int(streak), "transitions": move.ravel().tolist(), "ts_ns": int(g.ts_ns.iloc[-1]), "avg_volume": float(g["size"].iloc[-1] * 1000)}])

    return obs.withColumn("k", late).where(F.col("k") <= keep).drop("k").groupBy("symbol").applyInPandas(fit, "symbol long, regime string, state long, probability double, streak long, transitions array<double>, ts_ns long, avg_volume double")


def hmm_anomaly(t: DataFrame, q: DataFrame, probability: float = 0.8, streak: int = 5) -> DataFrame:
    """Symbols whose dark regime is likely and has lasted, and those that just came under pressure."""
    rows = hmm_regimes(t, q)
    dark = F.col("regime").isin("DARK_POOL_BUY", "DARK_POOL_SELL") & (F.col("probability") > probability) & (F.col("streak") > streak)
    fresh = F.col("regime").isin("BUYING_PRESSURE", "SELLING_PRESSURE") & (F.col("probability") > 0.9) & (F.col("streak") == 1)
    return rows.where(dark | fresh).select(
        "symbol", "ts_ns", F.when(dark, "HIDDEN_REFILL").otherwise("TRADE_CLUSTERING").alias("type"), F.round(F.when(dark, F.col("probability")).otherwise(0.8 * F.col("probability")), 4).alias("confidence"),
        F.when(dark, F.col("streak") / 10.0).otherwise(1.0).alias("magnitude"), F.when(dark, F.round(F.col("avg_volume") * F.col("streak") * 2, 1)).otherwise(0.0).alias("hidden"),
    )


# -- clusters ---------------------------------------------------------------------------------------------------------


def cluster_features(t: DataFrame, q: DataFrame) -> DataFrame:
    """Size against its moving average (from zero, factor 0.05), price change, minutes since the last trade, distance from
    the mid in spreads, side, volume rate."""
    one = Window.partitionBy("symbol").orderBy(*ORDER)
    past = F.reverse(F.collect_list("quantity").over(one.rowsBetween(-499, 0)))
    rows = asof(t, q, ["symbol"], F.col("ts_ns"), F.col("ts_ns"), ["quote_seq"], {"bid_e4": "bid_e4", "ask_e4": "ask_e4"}, DAY)
    rows = rows.select("*", past.alias("_p"), F.lag("price_e4").over(one).alias("p1"), ((F.col("ts_ns") - F.lag("ts_ns").over(one)) / float(MINUTE)).alias("dt"))
    average = F.aggregate(F.transform("_p", lambda x, i: x * 0.05 * F.pow(F.lit(0.95), i.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    spread, mid = F.col("ask_e4") - F.col("bid_e4"), (F.col("ask_e4") + F.col("bid_e4")) / 2.0
    return rows.select(
        "symbol", *ORDER, "quantity", "side", F.round(F.col("quantity") / average, 6).alias("size"), F.round(F.coalesce(ratio(F.col("price_e4") - F.col("p1"), F.col("p1")), F.lit(0.0)), 6).alias("change"), F.round(F.coalesce("dt", F.lit(1.0)), 9).alias("dt"),
        F.round(F.coalesce(ratio(F.abs(F.col("price_e4") - mid), spread), F.lit(0.5)), 6).alias("spread_ratio"), F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0).alias("direction"), F.round(F.coalesce(ratio(F.col("quantity"), F.col("dt")), F.col("quantity").cast("double")), 6).alias("rate"),
    )


def fit_clusters(x: np.ndarray, n: int = 5, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical unit-variance mixture: means, priors, responsibilities; it begins at every n-th part of the rows."""
    means, prior = x[np.arange(n) * len(x) // n].copy(), np.full(n, 1 / n)
    gamma = np.full((len(x), n), 1 / n)
    for _ in range(steps):
        d = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
        logs = np.log(np.maximum(prior, 1e-300))[None] - 0.5 * d
        gamma = np.exp(logs - logs.max(axis=1, keepdims=True))
        gamma /= gamma.sum(axis=1, keepdims=True)
        total = gamma.sum(axis=0)
        ok = total > 1e-12
        means[ok] = (gamma.T @ x)[ok] / total[ok, None]
        prior = np.where(ok, total / len(x), prior)
    return means, prior, gamma


def trade_clusters(t: DataFrame, q: DataFrame, keep: int = 500) -> DataFrame:
    """Clusters of the last trades of each symbol: sizes, burstiness, volatility, and the regime of their sequence."""
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("trade_seq")))
    names = ["size", "change", "dt", "spread_ratio", "direction", "rate"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(ORDER)).reset_index(drop=True)
        x = g[names].to_numpy(float)
        x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
        _, prior, gamma = fit_clusters(x)
        label = gamma.argmax(axis=1)
        moves = float((label[1:] != label[:-1]).mean()) if len(label) > 1 else 0.0
        rows = []
        for c in np.unique(label):
            own = g[label == c]
            sd, mean = own.dt.std(ddof=0), own.dt.mean()
            burst = float((sd - mean) / (sd + mean)) if sd + mean > 0 else 0.0
            rows.append({"symbol": g.symbol.iloc[0], "cluster": int(c), "trades": len(own), "avg_size": int(own.quantity.sum() // len(own)), "probability": len(own) / len(g), "prior": float(prior[c]), "burstiness": burst, "volatility": float(own.change.std(ddof=0)), "buy_share": float((own.side == "BUY").mean()), "ts_ns": int(g.ts_ns.iloc[-1])})
        out = pd.DataFrame(rows)
        out["dark"] = (out.avg_size > 10_000) & (out.burstiness < 0.3)
        dark = (out.dark & (out.probability > 0.7)).any()
        buys = float(out.loc[out.trades.idxmax(), "buy_share"])
        return out.assign(regime="DARK_POOL_ACTIVE" if dark else ("AGGRESSIVE_BUYING" if buys >= 0.5 else "AGGRESSIVE_SELLING") if moves > 0.3 else "ACCUMULATION" if buys > 0.7 else "DISTRIBUTION" if buys < 0.3 else "NORMAL")

    rows = cluster_features(t, q).withColumn("k", late).where(F.col("k") <= keep)
    return rows.groupBy("symbol").applyInPandas(fit, "symbol long, cluster long, trades long, avg_size long, probability double, prior double, burstiness double, volatility double, buy_share double, ts_ns long, dark boolean, regime string")


def cluster_anomaly(t: DataFrame, q: DataFrame) -> DataFrame:
    """Symbols with a likely dark cluster, and those whose clusters follow each other fast."""
    likely = F.col("dark") & (F.col("probability") > 0.7)
    sums = trade_clusters(t, q).groupBy("symbol", "regime", "ts_ns").agg(F.max(F.when(likely, F.col("probability"))).alias("p"), F.coalesce(F.sum(F.when(F.col("dark"), F.col("avg_size") * F.col("trades"))), F.lit(0)).alias("volume"))
    found = F.col("p").isNotNull()
    rows = sums.where(found | F.col("regime").isin("AGGRESSIVE_BUYING", "AGGRESSIVE_SELLING"))
    return rows.select("symbol", "ts_ns", F.round(F.when(found, 0.8 * F.col("p")).otherwise(0.8), 4).alias("confidence"), F.coalesce("p", F.lit(1.0)).alias("magnitude"), F.when(found, F.col("volume").cast("double")).otherwise(0.0).alias("hidden"))


# -- linear models ----------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def standard_scales(rows: DataFrame) -> DataFrame:
    """Mean, population deviation (floor 1e-5), least, largest and missing values of every dimension."""
    long_ = rows.select(F.posexplode("x").alias("dim", "v"))
    return long_.groupBy("dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.greatest(F.lit(1e-5), F.stddev_pop("v")), 6).alias("sd"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.count_if(F.col("v").isNull()).alias("missing"))


def fixed_weights(n: int = 64) -> list[float]:
    """Weights by a rule: every third one is zero."""
    return [0.0 if i % 3 == 2 else ((i * 7919) % 101 - 50) / 100.0 for i in range(n)]


def linear_scores(rows: DataFrame) -> DataFrame:
    """Score, sigmoid confidence raised by the rules it triggers (the last one names the type), at most 1."""
    s = dot(F.col("x"), fixed_weights()) + 0.1
    rows = rows.select("vec_id", F.round(s, 6).alias("score"))
    rules = ((0.8, "DARK_POOL_ACTIVITY", 0.2), (0.7, "HIDDEN_LIQUIDITY", 0.15), (0.6, "UNUSUAL_VOLUME", 0.1))
    kind, raised, mask = F.lit("NONE"), 1 / (1 + F.exp(-F.col("score"))), F.lit(0)
    for k, (limit, name, boost) in enumerate(rules):
        hit = F.col("score") > limit
        kind, raised, mask = F.when(hit, name).otherwise(kind), raised + F.when(hit, boost).otherwise(0.0), mask + F.when(hit, 1 << k).otherwise(0)
    return rows.select("vec_id", "score", kind.alias("type"), F.round(F.least(F.lit(1.0), raised), 6).alias("confidence"), mask.cast("long").alias("rules"))


def fit_elastic_net(rows: DataFrame, alpha: float = 0.01, mix: float = 0.5):
    """The library's distributed solver on standardised vectors; coefficients, intercept and R2."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    return LinearRegression(regParam=alpha, elasticNetParam=mix, standardization=True, maxIter=200, tol=1e-8).fit(data)


def elastic_net_report(rows: DataFrame) -> DataFrame:
    """Coefficients with importance (their share of the absolute sum) and whether they were selected."""
    model = fit_elastic_net(rows)
    weights = [float(w) for w in model.coefficients.toArray()]
    total = sum(map(abs, weights)) or 1.0
    table_ = [(k, w, abs(w) / total, w != 0.0) for k, w in enumerate(weights)]
    return rows.sparkSession.createDataFrame(table_, "dim long, weight double, importance double, selected boolean")


def elastic_net_scores(rows: DataFrame) -> DataFrame:
    model = fit_elastic_net(rows)
    return rows.select("vec_id", (dot(F.col("x"), [float(w) for w in model.coefficients.toArray()]) + float(model.intercept)).alias("prediction"))


def gradient_step(rows: DataFrame, weights: list[float], intercept: float = 0.0, rate: float = 0.01, shrink: float = 0.001) -> DataFrame:
    """Weights after one step down the gradient of the squared error over a batch, with L2 shrinkage: how a fitted model goes
    on with new rows. One pass; sums are made by dimension."""
    error = rows.withColumn("e", dot(F.col("x"), weights) + intercept - F.col("y"))
    parts = error.select("e", F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("e") * F.col("v")).alias("g"))
    before = F.element_at(F.array(*map(F.lit, weights)), F.col("dim") + 1)
    return parts.select("dim", F.round(before - rate * (F.col("g") + shrink * before), 8).alias("weight"))


def cross_validate(rows: DataFrame, alphas: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 3) -> DataFrame:
    """Root mean squared error of held-out folds (by vec_id) for each penalty."""
    out = []
    for alpha in alphas:
        squares, n = 0.0, 0
        for k in range(folds):
            held = F.pmod(F.col("vec_id"), F.lit(folds)) == k
            model = fit_elastic_net(rows.where(~held), alpha)
            gap = dot(F.col("x"), [float(w) for w in model.coefficients.toArray()]) + float(model.intercept) - F.col("y")
            r = rows.where(held).agg(F.sum(gap * gap).alias("s"), F.count("*").alias("n")).first()
            squares, n = squares + (r["s"] or 0.0), n + r["n"]
        out.append((alpha, (squares / max(1, n)) ** 0.5, n))
    return rows.sparkSession.createDataFrame(out, "alpha double, rmse double, held_out long")


def save_model(model, path: str, spark: SparkSession) -> None:
    """A fitted linear model as one JSON row: intercept and weights."""
    spark.createDataFrame([(float(model.intercept), [float(w) for w in model.coefficients.toArray()])], "intercept double, weights array<double>").coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> tuple[float, list[float]]:
    row = spark.read.schema("intercept double, weights array<double>").json(path).first()
    return row.intercept, list(row.weights)


# -- sequence models --------------------------------------------------------------------------------------------------


def seeded(shape: tuple[int, ...], seed: int) -> np.ndarray:
    """Xavier-scaled weights from a seed, since no trained ones exist."""
    return np.random.default_rng(seed).normal(0, (2 / sum(shape)) ** 0.5, shape)


def lstm(x: np.ndarray, hidden: int, seed: int) -> np.ndarray:
    """Hidden states of a layer over (rows, time, features)."""
    w, u = seeded((x.shape[2], 4 * hidden), seed), seeded((hidden, 4 * hidden), seed + 1)
    h, c, out = np.zeros((len(x), hidden)), np.zeros((len(x), hidden)), []
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k in range(x.shape[1]):
        i, f, g, o = np.split(x[:, k] @ w + h @ u, 4, axis=1)
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1)


def attend(x: np.ndarray, heads: int, seed: int) -> np.ndarray:
    """An encoder block: attention with several heads, then a GELU layer, both added to their input."""
    n, t, d = x.shape
    q, k, v = (x @ seeded((d, d), seed + s) for s in range(3))
    split = lambda a: a.reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3)
    score = split(q) @ split(k).transpose(0, 1, 3, 2) / (d // heads) ** 0.5
    score = np.exp(score - score.max(axis=-1, keepdims=True))
    mixed = (score / score.sum(axis=-1, keepdims=True)) @ split(v)
    x = x + mixed.transpose(0, 2, 1, 3).reshape(n, t, d) @ seeded((d, d), seed + 3)
    h = x @ seeded((d, 2 * d), seed + 4)
    h = 0.5 * h * (1 + np.tanh(0.7978845608028654 * (h + 0.044715 * h**3)))
    return x + h @ seeded((2 * d, d), seed + 5)


def positions(t: int, d: int) -> np.ndarray:
    k = np.arange(t)[:, None] / 10000 ** (2 * (np.arange(d) // 2) / d)[None]
    return np.where(np.arange(d) % 2 == 0, np.sin(k), np.cos(k))


def sequence_scores(rows: DataFrame, steps: int = 8) -> DataFrame:
    """Each vector as a sequence of eight parts: reconstruction error of an LSTM autoencoder, and two transformer heads."""

    def forward(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b.x.to_numpy()).reshape(len(b), steps, -1)
            code = lstm(lstm(x, 16, 1), 8, 3)[:, -1]
            back = lstm(np.repeat(code[:, None], steps, axis=1), 16, 5) @ seeded((16, x.shape[2]), 7)
            error = np.sqrt(((back - x) ** 2).mean(axis=(1, 2)))
            by_step, by_feature = np.sqrt(((back - x) ** 2).mean(axis=2)), np.sqrt(((back - x) ** 2).mean(axis=1))
            e = x @ seeded((x.shape[2], 16), 11) + positions(steps, 16)
            for layer in range(2):
                e = attend(e, 4, 20 + 10 * layer)
            pooled = e.mean(axis=1)
            direction = np.tanh(pooled @ seeded((16, 1), 41))[:, 0]
            anomaly = 1 / (1 + np.exp(-(pooled @ seeded((16, 1), 43))[:, 0]))
            yield pd.DataFrame({"vec_id": b.vec_id, "error": error, "direction": direction, "anomaly": anomaly, "steps": list(by_step), "parts": list(by_feature)})

    return rows.select("vec_id", "x").mapInPandas(forward, "vec_id long, error double, direction double, anomaly double, steps array<double>, parts array<double>")


def pattern_class(z: Column, steps: Column, parts: Column, limit: Column) -> Column:
    """What kind of anomaly a sequence's errors show: by time step (over `limit` they are anomalous) and by feature."""
    at = F.filter(F.transform(steps, lambda e, i: F.when(e > limit, i)), lambda i: i.isNotNull())
    gaps = F.transform(F.slice(at, 2, 1_000_000), lambda x, i: (x - F.get(at, i)).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = ratio(total(gaps), F.size(gaps))
    spread = ratio(total(F.transform(gaps, lambda g: (g - mean) * (g - mean))), F.size(gaps))
    periodic = F.coalesce((F.size(at) > 2) & (spread < 0.2 * mean), F.lit(False))
    broken = F.array_max(parts) > 3 * total(parts) / F.size(parts)
    return F.when(z <= 3, "NORMAL").when(F.size(at) > 0.8 * F.size(parts), "REGIME_CHANGE").when(periodic, "CYCLIC_ANOMALY").when(z > 5, "SEQUENCE_NOVELTY").when(broken, "CORRELATION_BREAK").otherwise("TREND_BREAK")


def sequence_anomalies(rows: DataFrame) -> DataFrame:
    """Errors as z-scores and ranks against all others, with a type by strength."""
    scored = sequence_scores(rows)
    sums = scored.agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("sd"))
    z = (F.col("error") - F.col("m")) / F.col("sd")
    kind = F.when(z > 3, "SEQUENCE_ANOMALY").when(z > 2, "STATISTICAL_ANOMALY").when(z > 1.5, "PATTERN_CHANGE").otherwise("NONE")
    pattern = pattern_class(z, F.col("steps"), F.col("parts"), F.col("m") + 3 * F.col("sd"))
    return scored.crossJoin(F.broadcast(sums)).select("vec_id", "error", z.alias("z"), kind.alias("type"), pattern.alias("pattern"), "direction", "anomaly")


def inference_stub(rows: DataFrame) -> DataFrame:
    """The inference entry point is a constant until a trained model is put there; it claims nothing."""
    return rows.select("vec_id", F.lit(0.5).alias("prediction"), F.lit(0.8).alias("confidence"), F.lit(0).cast("long").alias("kind"), F.lit(1000).cast("long").alias("latency_us"))


def _tq(f):
    return lambda spark, sf: f(trades(spark, sf), quotes(spark, sf))


def _x(f):
    return lambda spark, sf: f(vectors(spark, sf))


_ROWS50 = "(PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_WEIGHTS = "[" + ", ".join(f"{w!r}::DOUBLE" for w in fixed_weights()) + "]"
QUERIES = {
    "hmm_observations": _tq(hmm_observations),
    "hmm_regimes": _tq(hmm_regimes),
    "cluster_features": _tq(cluster_features),
    "trade_clusters": _tq(trade_clusters),
    "standard_scales": _x(standard_scales),
    "linear_scorer": _x(linear_scores),
    "elastic_net": _x(elastic_net_report),
    "elastic_net_scores": _x(elastic_net_scores),
    "elastic_net_cv": _x(cross_validate),
    "gradient_step": lambda spark, sf: gradient_step(vectors(spark, sf), fixed_weights(), 0.1),
    "sequence_scores": _x(sequence_anomalies),
    "inference_stub": _x(inference_stub),
}
SQL = {
    "hmm_observations": f"""WITH {TICKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, quote_seq) AS nq, min(ts_ns) OVER (PARTITION BY symbol) AS q0 FROM quotes),
j AS (SELECT t.*, bid_size, ask_size, nq, q0 FROM trades t ASOF LEFT JOIN n ON t.symbol = n.symbol AND t.ts_ns >= n.ts_ns),
o AS (SELECT symbol, trade_seq, ts_ns, avg(quantity) OVER w / avg(quantity) OVER e AS volume, coalesce((price_e4 - first_value(price_e4) OVER w) / nullif(first_value(price_e4) OVER w, 0), 0) AS change, coalesce((bid_size - ask_size) / (bid_size + ask_size), 0) AS imbalance,
  coalesce(count(*) OVER w / nullif((max(ts_ns) OVER w - min(ts_ns) OVER w) / {float(MINUTE)}, 0), 1) AS trade_rate, avg(quantity) OVER w / 1000 AS size, coalesce(nq / nullif((ts_ns - q0) / {float(MINUTE)}, 0), 1) AS quote_rate,
  CASE WHEN sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) OVER w > 0 THEN 'BUY' ELSE 'SELL' END AS net, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, trade_seq) AS k
  FROM j WINDOW w AS {_ROWS50}, e AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq ROWS UNBOUNDED PRECEDING))
SELECT symbol, trade_seq, ts_ns, {', '.join(f'round({c}, 6) AS {c}' for c in OBSERVED)}, net FROM o WHERE k >= 10""",
    "cluster_features": f"""WITH {TICKS_SQL}, a AS (SELECT *, row_number() OVER o AS n, lag(price_e4) OVER o AS p1, (ts_ns - lag(ts_ns) OVER o) / {float(MINUTE)} AS dt FROM trades WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, trade_seq)),
v AS (SELECT x.symbol, x.trade_seq, sum(y.quantity * 0.05::DOUBLE * pow(0.95::DOUBLE, x.n - y.n)) AS avg_ FROM a x JOIN a y ON x.symbol = y.symbol AND y.n BETWEEN x.n - 499 AND x.n GROUP BY ALL),
j AS (SELECT a.*, avg_, q.bid_e4 AS b, q.ask_e4 AS k FROM (SELECT * FROM a JOIN v USING (symbol, trade_seq)) a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.ts_ns >= q.ts_ns)
SELECT symbol, trade_seq, ts_ns, quantity, side, round(quantity / avg_, 6) AS size, round(coalesce((price_e4 - p1) / nullif(p1, 0), 0), 6) AS change, round(coalesce(dt, 1), 9) AS dt, round(coalesce(abs(price_e4 - (b + k) / 2.0::DOUBLE) / nullif(k - b, 0), 0.5::DOUBLE), 6) AS spread_ratio,
  CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction, round(coalesce(quantity / nullif(dt, 0), quantity::DOUBLE), 6) AS rate FROM j""",
    "standard_scales": "WITH l AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT dim, round(avg(v), 6) AS mean, round(greatest(1e-5, stddev_pop(v)), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) FILTER (v IS NULL) AS missing FROM l GROUP BY dim",
    "gradient_step": f"""WITH e AS (SELECT embedding, list_dot_product(embedding::DOUBLE[], {_WEIGHTS}) + 0.1::DOUBLE - label::DOUBLE AS e FROM embeddings), l AS (SELECT e, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM e), g AS (SELECT dim, avg(e * v) AS g FROM l GROUP BY dim)
SELECT dim, round({_WEIGHTS}[dim + 1] - 0.01::DOUBLE * (g + 0.001::DOUBLE * {_WEIGHTS}[dim + 1]), 8) AS weight FROM g""",
    "linear_scorer": f"""WITH s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_WEIGHTS}) + 0.1::DOUBLE, 6) AS score FROM embeddings)
SELECT vec_id, score, CASE WHEN score > 0.6 THEN 'UNUSUAL_VOLUME' ELSE 'NONE' END AS type,
  round(least(1.0::DOUBLE, 1 / (1 + exp(-score)) + CASE WHEN score > 0.8 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN score > 0.7 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN score > 0.6 THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence,
  (CASE WHEN score > 0.8 THEN 1 ELSE 0 END + CASE WHEN score > 0.7 THEN 2 ELSE 0 END + CASE WHEN score > 0.6 THEN 4 ELSE 0 END)::BIGINT AS rules FROM s""",
    "inference_stub": "SELECT vec_id, 0.5::DOUBLE AS prediction, 0.8::DOUBLE AS confidence, 0::BIGINT AS kind, 1000::BIGINT AS latency_us FROM embeddings",
}
