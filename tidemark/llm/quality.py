"""Quality rules: base statistics of whole texts, then robust multivariate outliers.

Statistics are taken by array functions within the row, so no text or word is shuffled. For the second part a vector of
transformed statistics is written once; for each language and source a minimum-covariance-determinant estimate is found
by concentration (C-steps): estimate centre and covariance from the three quarters of the documents with the smallest
Mahalanobis distances, and again. Three deterministic starts are tried: medians with coordinate-wise deviations, the
covariance of tanh-transformed values, and that of spatial signs. After TRIALS steps the start with the smallest
determinant goes on alone, until no group's determinant falls any more (STEPS at most).

A step is one pass and one small shuffle: documents are summed by (group, start, distance bucket), the sums are written,
and up to three quarters of the group are added up, of the last bucket the share that is still missing. A Cholesky factor
is worked out in columns. Sums are of fixed-point integers, so the result does not depend on how rows are dealt.
Covariances are regularised: each variance gets a floor on top, so that a statistic that is nearly constant in a group
does not make every other value an outlier; C-steps lower the determinant of such covariances, too. Documents further than
CUT from their group's centre are rejected.

Groups of under LEAST documents are judged with their language's pool of such groups, and if that is still too small,
with the pool of all; a pool of under LEAST rejects nothing.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows count as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, materialize, table

LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Documents that a group must have; share of a group that the estimate rests on; steps with all starts, and at most.
LEAST, SHARE, TRIALS, STEPS = 100, 0.75, 2, 20
#: A group's log determinant has come to rest when a step changes it by less.
AT_REST = 1e-4
#: Squared Mahalanobis distance from which a document is rejected: the 0.999 quantile of chi2 with 5 degrees.
CUT = 20.515
#: (share) / P(chi2 with 7 degrees <= the share's quantile of chi2 with 5): makes the estimate fit normal data.
CONSISTENCY = 1.41
#: Standard deviations that are added (as variances) to each statistic's own.
FLOOR = (0.35, 0.06, 0.08, 0.08, 0.12)
P = len(FLOOR)
SCALE = 10_000


def base_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    rows = rows.withColumn("n_words", F.size("_w").cast("long"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    rows = rows.withColumn("_h", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_s", F.sort_array("_h"))
    again = F.filter("_s", lambda x, i: (i > 0) & (F.get("_s", i - 1) == x))
    rows = rows.withColumn("_d", F.array_distinct(again))
    few = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("_p", F.when(F.size("_d") > 64, pairs))
    twice = F.filter("_p", lambda e, j: F.coalesce(F.get("_p", j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("_p", j + 1)["x"] == e["x"], F.lit(False)))
    many = F.sort_array(F.transform(twice, lambda e: e["i"]))
    rows = rows.withColumn("_at", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= 64, few).otherwise(many))
    cover = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        *keep,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        cover.alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def vector() -> list[Column]:
    """Fixed-point transformed statistics: length, word length, symbols, repeated lines, repeated words."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = [F.ln(n), F.ln(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _factor(groups: DataFrame) -> DataFrame:
    """From g, s, m0.. and covariances c{i}{j} (j <= i): g, s, m0.., the Cholesky factor l{i}{j} and the log determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((F.ln(f"l{i}{i}") for i in range(1, P)), F.ln("l00")) * 2
    return groups.select("g", "s", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], det.alias("det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2 to rows with x*, m*, l*."""
    for i in range(P):
        rest = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", total)


def _start(rows: DataFrame) -> DataFrame:
    """The starts s = 0, 1, 2: medians and absolute deviations of values rounded to hundredths (exact, and the states stay
    small), and around them the covariances of tanh-transformed values and of spatial signs."""
    step = SCALE // 100
    cells = [F.round(F.col(f"x{i}") / step) for i in range(P)]
    mids = _small(rows.groupBy("g").agg(*[F.percentile(c, 0.5).alias(f"m{i}") for i, c in enumerate(cells)]), "quality-medians")
    away = rows.join(mids, "g").groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile(F.abs(F.round(cells[i] - F.col(f"m{i}"))), 0.5).alias(f"a{i}") for i in range(P)])
    sd = lambda i: F.sqrt(F.pow(F.col(f"a{i}") / 100 * 1.4826, 2.0) + FLOOR[i] ** 2)
    scales = _small(away.select("g", *[(F.col(f"m{i}") / 100).alias(f"m{i}") for i in range(P)], *[sd(i).alias(f"d{i}") for i in range(P)]), "quality-scales")
    own = rows.join(scales, "g").select("g", *[((F.col(f"x{i}") / SCALE - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)])
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    own = own.withColumn("_r", F.greatest(length, F.lit(1e-9)))
    fixed = lambda x: F.round(x * 1_000_000).cast("long")
    own = own.select("g", *[fixed(F.tanh(f"z{i}")).alias(f"t{i}") for i in range(P)], *[fixed(F.col(f"z{i}") / F.col("_r")).alias(f"u{i}") for i in range(P)])
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    total = lambda k, i, j: F.sum((F.col(f"{k}{i}") * F.col(f"{k}{j}")).cast("decimal(38,0)")).cast("double").alias(f"{k}{i}{j}")
    sums = own.groupBy("g").agg(F.count("*").alias("n"), *[total(k, i, j) for k in "tu" for i, j in pairs])
    sums = sums.join(scales, "g")
    shape = lambda k, i, j: F.col(f"{k}{i}{j}") / F.sqrt(F.greatest(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}"), F.lit(1.0)))
    plain = lambda i, j: F.lit(1.0 if i == j else 0.0)
    starts = [plain, lambda i, j: shape("t", i, j) if i != j else F.lit(1.0), lambda i, j: shape("u", i, j) if i != j else F.lit(1.0)]
    out = None
    for s, cor in enumerate(starts):
        one = sums.select("g", F.lit(s).alias("s"), *[f"m{i}" for i in range(P)], *[(cor(i, j) * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in pairs])
        out = one if out is None else out.unionByName(one)
    return _factor(out)


def _concentrate(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One step: the estimates from the nearest three quarters of each group, for each of its starts."""
    near = _distance(rows.join(groups, "g")).withColumn("b", F.floor(F.ln(F.col("d2") + 1e-6) * 64).cast("long"))
    product = lambda i, j: F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)"))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"p{i}{j}" for i in range(P) for j in range(i + 1)]]
    sums = near.groupBy("g", "s", "b").agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(P)], *[product(i, j).alias(f"p{i}{j}") for i in range(P) for j in range(i + 1)])
    sums = materialize(sums, "quality-sums")  # dealt by all three keys; what is dealt by group below is sums only
    up = Window.partitionBy("g", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy("g", "s")).alias("all"))
    half = F.ceil(F.col("all") * SHARE)
    taken = sums.where(F.col("below") < half).withColumn("part", F.least(F.lit(1.0), (half - F.col("below")) / F.col("n")))
    one = taken.groupBy("g", "s").agg(*[F.sum(F.col(x).cast("double") * F.col("part")).alias(x) for x in names])
    mean = lambda i: F.col(f"s{i}") / F.col("n") / SCALE
    cov = lambda i, j: (F.col(f"p{i}{j}") / F.col("n") / SCALE**2 - mean(i) * mean(j)) * CONSISTENCY + (FLOOR[i] ** 2 if i == j else 0.0)
    return _factor(one.select("g", "s", *[mean(i).alias(f"m{i}") for i in range(P)], *[cov(i, j).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]))


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of groups, written in a few files: its size is then known to be small, and the planner need not deal the
    documents by group."""
    return materialize(df.repartition(4), name)


def estimates(fit: DataFrame) -> DataFrame:
    """g, centre and factor of the estimate with the smallest determinant found, from rows (g, x0, ...)."""
    groups = _small(_start(fit), "quality-estimates")
    for _ in range(TRIALS):
        groups = _small(_concentrate(fit, groups), "quality-estimates")
    values = [c for c in groups.columns if c != "g"]
    groups = groups.groupBy("g").agg(F.min_by(F.struct(*values), F.struct(F.round("det", 9), "s")).alias("best")).select("g", "best.*")
    groups = _small(groups, "quality-estimates")
    for _ in range(STEPS - TRIALS):
        after = _small(_concentrate(fit, groups), "quality-estimates")
        moved = after.join(groups.select("g", F.col("det").alias("was")), "g").agg(F.max(F.abs(F.col("det") - F.col("was"))).alias("d")).first()["d"]
        groups = after
        if moved is None or moved < AT_REST:
            break
    return groups.drop("s")


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds g, the group that a document is judged with; null: none."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = stats.withColumn("_lang", name("lang")).withColumn("_source", name("source"))
    n = rows.where("not base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < LEAST)
    pools = small.groupBy("_lang").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST).agg(F.sum("pool").alias("rest"))
    n = n.join(pools, "_lang", "left").crossJoin(F.broadcast(rest))  # one row
    own, lang = F.concat_ws("\x1f", F.lit("s"), "_lang", "_source"), F.concat_ws("\x1f", F.lit("l"), "_lang")
    g = F.when(F.col("n") >= LEAST, own).when(F.col("pool") >= LEAST, lang).when(F.col("rest") >= LEAST, F.lit("all"))
    names = _small(n.select("_lang", "_source", g.alias("g")), "quality-names")
    return rows.join(names, ["_lang", "_source"], "left").drop("_lang", "_source")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` (of docs' columns, lang and source among them), the base columns, d2 and kept, for each row of docs."""
    stats = base_statistics(docs, keep)
    stats = materialize(stats.select("*", *vector()), "quality-stats")
    rows = _grouped(stats)
    fit = rows.where("not base_failed and g is not null").select("g", *[f"x{i}" for i in range(P)])
    groups = estimates(materialize(fit, "quality-groups"))
    far = _distance(rows.join(groups, "g", "left"))
    d2 = F.when(~F.col("base_failed"), F.round("d2", 4))
    return far.withColumn("d2", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, d2 (null: judged by the base rules alone), kept. One row for each row of docs."""
    return judged(docs, ["doc_id", "lang", "source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the rules reject. Rows are written once with their statistics and pass whole, so that each is judged by
    itself: no row goes because of another with its id, and no text is shuffled.

    A null or empty text has no words and goes; null ids and repeated ids stay or go by their own texts; repeated rows stay
    or go together; null languages and sources are groups; an empty table stays empty; other columns pass, whatever they
    are called."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    rows = judged(whole, ["_row", "lang", "source"]).where("kept")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
