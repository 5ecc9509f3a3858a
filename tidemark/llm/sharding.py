"""Sharding by a hierarchical weighted hash tree: a document descends region, rack and shard; at each node every child
draws -ln(u) / weight, u a hash of (document, child), and the smallest draw wins. A subtree's weight is that of its
shards, so a changed weight moves documents only between that subtree and the rest.

Law `key`: doc_id and the tree decide. A shard that is added later has one draw of its own, with its own weight, beside
the regions' at the root (a graft): whoever it wins goes straight down to it and all others stay. So one more shard takes
its share by weight, and takes rows only into itself, wherever in the tree it is put.

Slots: within a shard rows are counted in blocks of a hash of doc_id; block counts are summed into bases, and rows are
numbered inside their block, so no task holds a whole shard.

Defined cases: a null doc_id is hashed as the text 'null'; a null text has size 1 and checksum 0; repeated rows go to
one shard and get slots of their own, ordered by doc_id and checksum; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_base, table

BLOCKS = 256


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """shards: the first tree; grafts: shards added since, in order."""

    shards: tuple[Shard, ...]
    grafts: tuple[Shard, ...] = field(default=())

    def with_shard(self, shard: Shard) -> Tree:
        return Tree(self.shards, (*self.grafts, shard))


#: Sixteen shards: two regions of two racks of four.
TREE = Tree(tuple(Shard(n // 8, n // 4, n) for n in range(16)))
GROWN = TREE.with_shard(Shard(1, 3, 16))


def draw(node: str, weight: float) -> Column:
    """An exponential variable with the rate `weight` from 52 bits of an md5 of (node, document)."""
    key = F.concat(F.lit(f"{node}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 1.0) / F.lit(float(2**52))
    return -F.ln(u) / F.lit(float(weight))


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """The value beside the smallest draw."""
    pairs = [F.struct(d.alias("d"), v.alias("v")) for d, v in draws]
    return (F.least(*pairs) if len(pairs) > 1 else pairs[0])["v"]


def placed(rows: DataFrame, tree: Tree, name: str) -> DataFrame:
    """Adds the shard as `name`. Each level is a column of its own, so a row draws only among its own node's children."""
    regions = sorted({s.region for s in tree.shards})
    racks = sorted({(s.region, s.rack) for s in tree.shards})
    total = lambda ok: sum(s.weight for s in tree.shards if ok(s))
    grafts = [(draw(f"graft {s.number}", s.weight), F.lit(-1 - s.number)) for s in tree.grafts]

    def choose(column: str, options: dict, level: str) -> Column:
        out = F.when(F.col(column) < 0, F.col(column))
        for node, children in options.items():
            out = out.when(F.col(column) == node, _least([(draw(f"{level} {n}", w), F.lit(n)) for n, w in children]))
        return out

    top = _least([*((draw(f"region {r}", total(lambda s, r=r: s.region == r)), F.lit(r)) for r in regions), *grafts])
    second = {r: [(k, total(lambda s, k=k: s.rack == k)) for q, k in racks if q == r] for r in regions}
    third = {k: [(s.number, s.weight) for s in tree.shards if s.rack == k] for _, k in racks}
    out = rows.withColumn("_region", top).withColumn("_rack", choose("_region", second, "rack")).withColumn("_leaf", choose("_rack", third, "shard"))
    return out.withColumn(name, F.when(F.col("_leaf") < 0, -1 - F.col("_leaf")).otherwise(F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`, gapless from 0 within `shard`: by block, then `order`."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("_b", F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("long"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    bases = prefix_base(counts, "_b", "_n", ["shard"], width=BLOCKS)
    within = Window.partitionBy("shard", "_b").orderBy(*order)
    numbered = rows.withColumn("_k", F.row_number().over(within))
    return numbered.join(F.broadcast(bases), ["shard", "_b"]).withColumn("slot", F.col("base") + F.col("_k") - 1).drop("base", "_k", "_b", "_n")


def shard(docs: DataFrame, tree: Tree = TREE, grown: Tree = GROWN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. The bases that are broadcast have shards x BLOCKS rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    rows = placed(placed(rows, tree, "shard"), grown, "grown_shard")
    return with_slots(rows, ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _least_sql(options: list[tuple[str, float, int]]) -> str:
    """The number beside the smallest draw."""
    draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5('{node}|' || doc), 1, 13))::BIGINT::DOUBLE + 1) / {float(2**52)}::DOUBLE) / {float(w)}::DOUBLE, 'v': {v}}}" for node, w, v in options)
    return f"(list_sort([{draws}])[1]).v"


def _place_sql(tree: Tree) -> tuple[str, str, str]:
    """Region, rack (by `region`) and shard (by `rack`) as expressions; below 0: a graft."""
    weight = lambda ok: sum(s.weight for s in tree.shards if ok(s))
    regions, racks = sorted({s.region for s in tree.shards}), sorted({(s.region, s.rack) for s in tree.shards})
    top = _least_sql([*((f"region {r}", weight(lambda s, r=r: s.region == r), r) for r in regions), *((f"graft {s.number}", s.weight, -1 - s.number) for s in tree.grafts)])
    second = "".join(f" WHEN {r} THEN " + _least_sql([(f"rack {k}", weight(lambda s, k=k: s.rack == k), k) for q, k in racks if q == r]) for r in regions)
    third = "".join(f" WHEN {k} THEN " + _least_sql([(f"shard {s.number}", s.weight, s.number) for s in tree.shards if s.rack == k]) for _, k in racks)
    return top, f"CASE region{second} ELSE region END", f"CASE rack{third} ELSE rack END"


def _sql(tree: Tree, grown: Tree) -> str:
    # the checksum, byte by byte from the table of the 256 remainders
    table = "list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    a, b = _place_sql(tree), _place_sql(grown)
    place = lambda x, n: f"SELECT *, {x[2]} AS {n} FROM (SELECT *, {x[1]} AS rack FROM (SELECT *, {x[0]} AS region FROM "
    return f"""
WITH t AS (SELECT {table} AS crc_table),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS doc, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, doc, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
s AS ({place(a, 'shard')}k))), g AS ({place(b, 'grown')}(SELECT doc_id, doc, size, text_crc32, shard FROM s))))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc), 1, 2), doc_id, text_crc32) - 1 AS slot, CASE WHEN grown < 0 THEN -1 - grown ELSE grown END AS grown_shard FROM g"""


SQL_OP9 = _sql(TREE, GROWN)


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
