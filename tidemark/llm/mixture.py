"""Mixing sources to target weights, over a tree of domain, language and source.

Weights are handed down the tree as token budgets. At each node the budget is poured into the children by weight; a
child that holds less than its share gives what it lacks back to its siblings, by weight, and only what all of them
cannot take goes up to the ancestors' other children (a node never gets more than its subtree holds). A leaf may be read
up to `epochs` times. Each epoch has its own seeded order; a leaf's selection is its full epochs and then the first
tokens of the next epoch, up to the budget to the token.

All of it is DataFrame functions. The texts are read once, for their word counts; the tree is worked out on one row for
each leaf. Orders are by md5 of (seed, epoch, doc_id): documents are summed by the first three digits, these sums by
blocks of 64, and what meets by leaf is 64 blocks, then the 64 sums of the block in which the budget ends. Only the
documents that share those digits are sorted, so a hot leaf is never in one task.

Budgets are whole tokens, rounded down at every node. Defined cases: a null text has no tokens; null languages and
sources are the leaves 'und' and 'none'; nodes without a weight have weight 1, with weight 0 they get nothing; repeated
rows count each, and rows with equal doc_ids stand next to each other in the order, by text length; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, table

DOMAINS = ("web", "books", "code", "talk")
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 1, "talk": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 3},
    "source": {"src0": 4, "src1": 2, "src2": 3},
}
SEED, SHARE, EPOCHS, DIGITS = 11, 1.25, 3, 3
#: First digits of a hash that are summed together: 64 blocks of 64.
BLOCK = 64
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain that a source's number says; without one, the first."""
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(source, '[0-9]+', 0), '') AS int)"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def _leaf(docs: DataFrame) -> list[Column]:
    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")]


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out


def pour(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `got` to rows (parent, child, weight, cap, budget): the parent's budget by weight, nobody above its cap."""
    ratio = (F.col("cap") / F.col("weight")).alias("_ratio")
    rows = children.where("weight > 0").select("*", ratio)
    order = Window.partitionBy(*parent).orderBy("_ratio", child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("*", ((F.col("budget") - before).cast("double") / rest).alias("_level"))
    open_ = F.col("_level") * F.col("weight") < F.col("cap")
    rows = rows.select("*", open_.alias("_open"), F.max(F.when(open_, F.col("_level"))).over(Window.partitionBy(*parent)).alias("_final"))
    return rows.withColumn("got", F.when(F.col("_open"), F.floor(F.greatest(F.lit(0.0), F.col("_final") * F.col("weight"))).cast("long")).otherwise(F.col("cap"))).drop("_ratio", "_level", "_open", "_final")


def budgets(leaves: DataFrame, weights: dict, share: float, epochs: int) -> DataFrame:
    """domain, lang, source, tokens and the leaf's budget, from (domain, lang, source, tokens): few rows throughout."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("budget"))
    top = domains.crossJoin(F.broadcast(total)).withColumn("weight", _weight("domain", weights)).withColumn("root", F.lit(0))
    top = pour(top, ["root"], "domain").select("domain", F.col("got").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain").withColumn("weight", _weight("lang", weights))
    mid = pour(langs, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("weight", _weight("source", weights))
    return pour(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("got").alias("budget"))


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _digits(key: Column) -> Column:
    return F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("long")


def plan(docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): doc_id, domain, lang, source, n_tokens of all documents; and for each leaf its full epochs, the
    tokens of the epoch after them, the digits in which those end (edge) and the tokens before the edge."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select("doc_id", *_leaf(docs), count.alias("n_tokens")), "mixture-counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    found = budgets(leaves, weights, share, epochs)
    one = F.greatest(F.col("tokens"), F.lit(1))
    found = materialize(found.select(*LEVELS, "budget", F.expr("budget div greatest(tokens, 1)").alias("full"), (F.col("budget") % one).alias("rest")), "mixture-budgets")
    sums = rows.join(found, list(LEVELS)).select(*LEVELS, "rest", "n_tokens", _digits(_order(seed)).alias("b")).groupBy(*LEVELS, "rest", "b").agg(F.sum("n_tokens").alias("n"))
    sums = materialize(sums, "mixture-sums")  # dealt by all its keys; what is dealt by leaf below is blocks of sums only
    blocks = materialize(sums.groupBy(*LEVELS, "rest", F.expr(f"b div {BLOCK}").alias("c")).agg(F.sum("n").alias("n")), "mixture-blocks")
    found_c = _edge(blocks.withColumn("start", F.lit(0).cast("long")), "c")
    inside = sums.withColumn("c", F.expr(f"b div {BLOCK}")).join(found_c.select(*LEVELS, F.col("c"), F.col("before").alias("start")), [*LEVELS, "c"])
    edges = _edge(inside, "b").select(*LEVELS, F.col("b").alias("edge"), "before")
    return rows, materialize(found.join(edges, list(LEVELS), "left"), "mixture-leaves")


def _edge(sums: DataFrame, key: str) -> DataFrame:
    """Where in each leaf the running sum of n over `key`, from `start`, reaches rest, and the sum before that."""
    up = Window.partitionBy(*LEVELS).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.select(*LEVELS, "rest", key, "n", (F.col("start") + F.sum("n").over(up)).alias("upto"))
    return upto.where("upto - n < rest and upto >= rest").select(*LEVELS, key, (F.col("upto") - F.col("n")).alias("before"))


def select(rows: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies (full epochs), prefix_tokens (of the epoch after them)."""
    every = rows.join(leaves, list(LEVELS), "left").withColumn("full", F.coalesce("full", F.lit(0))).withColumn("_key", _order(seed))
    every = every.withColumn("_at", _digits(F.col("_key")) - F.coalesce("edge", F.lit(-1)))
    up = Window.partitionBy(*LEVELS).orderBy("_key", "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = every.where("_at = 0").withColumn("_left", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(up), F.lit(0)))
    at_edge = at_edge.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least("n_tokens", "_left")).cast("long"))
    others = every.where("_at <> 0").withColumn("prefix_tokens", F.when(F.col("_at") < 0, F.col("n_tokens")).otherwise(F.lit(0)).cast("long"))
    out = ["doc_id", *LEVELS, "n_tokens", F.col("full").cast("long").alias("copies"), "prefix_tokens"]
    return at_edge.select(*out).unionByName(others.select(*out))


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(*plan(table(spark, sf_dir, "documents")))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for one epoch at most and nine tenths of all tokens, whole: a document in which a budget ends stays.
    Only the few documents at the edges are joined by id; all others are decided by their own hash.

    Rows with one id, null included, in one leaf stay or go together; a null text has no tokens and stays where its place
    in the order is before the edge; null languages and sources are leaves; an empty table stays empty; other columns
    pass, whatever they are called."""
    rows, leaves = plan(docs, share=0.9, epochs=1)
    edge = select(rows.join(leaves.where("edge is not null").select(*LEVELS, "edge", "full"), list(LEVELS)).where(_digits(_order(SEED)) == F.col("edge")).drop("edge", "full"), leaves)
    edge = edge.groupBy(F.col("doc_id").alias("_mix_edge_id")).agg((F.max("prefix_tokens") > 0).alias("_mix_edge_in"))
    edge = materialize(edge, "mixture-edge")  # of known size, so that the planner need not shuffle the documents
    names = {c: f"_mix_leaf_{c}" for c in LEVELS}
    lookup = leaves.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("full").alias("_mix_full"), F.coalesce("edge", F.lit(-1)).alias("_mix_edge"))
    leaf = dict(zip(LEVELS, _leaf(docs), strict=True))
    every = docs.select("*", *[leaf[c].alias(f"_mix_own_{c}") for c in LEVELS])
    every = every.join(lookup, [F.col(f"_mix_own_{c}") == F.col(n) for c, n in names.items()], "left")
    key = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce("_mix_full", F.lit(0)).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    every = every.withColumn("_mix_at", _digits(key) - F.coalesce("_mix_edge", F.lit(-1)))
    every = every.join(edge, F.col("doc_id").eqNullSafe(F.col("_mix_edge_id")), "left")
    stays = (F.coalesce("_mix_full", F.lit(0)) > 0) | (F.col("_mix_at") < 0) | ((F.col("_mix_at") == 0) & F.coalesce("_mix_edge_in", F.lit(False)))
    return every.where(stays).select(*docs.columns)


def _weight_sql(level: str) -> str:
    return f"CASE {level}" + "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _pour_sql(source: str, parent: str, child: str) -> str:
    return f"""SELECT * EXCLUDE (lv, op, fin), CASE WHEN op THEN floor(greatest(0.0::DOUBLE, fin * weight))::BIGINT ELSE cap END AS got FROM (
  SELECT *, lv * weight < cap AS op, max(lv) FILTER (lv * weight < cap) OVER (PARTITION BY {parent}) AS fin FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
    FROM ({source}) WHERE weight > 0 WINDOW o AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {child})))"""


SQL_OP3 = rf"""
WITH r AS (SELECT doc_id, ['{"', '".join(DOMAINS)}'][coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS INT), 0) % {len(DOMAINS)} + 1] AS domain,
    coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {EPOCHS} AS cap FROM r GROUP BY ALL),
d AS ({_pour_sql(f"SELECT *, {_weight_sql('domain')} AS weight, 0 AS root FROM (SELECT domain, sum(cap)::BIGINT AS cap FROM leaves GROUP BY 1), (SELECT floor(sum(tokens)::DOUBLE * {SHARE})::BIGINT AS budget FROM leaves)", 'root', 'domain')}),
l AS ({_pour_sql(f"SELECT x.*, d.got AS budget, {_weight_sql('lang')} AS weight FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL) x JOIN d USING (domain)", 'domain', 'lang')}),
s AS ({_pour_sql(f"SELECT x.*, l.got AS budget, {_weight_sql('source')} AS weight FROM leaves x JOIN l USING (domain, lang)", 'domain, lang', 'source')}),
b AS (SELECT domain, lang, source, got // greatest(tokens, 1) AS copies, got % greatest(tokens, 1) AS rest FROM s),
k AS (SELECT r.*, coalesce(copies, 0) AS copies, coalesce(rest, 0) AS rest, md5('{SEED}:' || coalesce(copies, 0) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM r LEFT JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, copies::BIGINT AS copies,
  greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS prefix_tokens
FROM k"""
