"""MinHash near-duplicates: bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; its sketch, the SKETCH smallest of them.

1. Documents with equal sets form classes (128-bit fingerprints); the smallest doc_id stands for the class.
2. Inverted lists of the representatives' sketches. In each list all members meet one pivot only, the member with the most
   values in long lists; the pairs with the most overlap are filtered by the union sketch's estimate and verified on full
   sets. This is linear in the lists, and joins large groups of near copies into components.
3. All pairs of a list of up to HOT members that are still in different components are compared as well: overlaps, then
   union sketches, then full sets decide. Longer lists are left to "typical" documents, those with less than the share
   RARE of their sketch in shorter lists. Of a document that is not typical, about half of the whole set or more lies
   outside of long lists. If another one is similar enough, a quarter of its set is both shared and outside of long lists,
   which makes twelve values of the sketch on average, so that a shorter list brings the two together, whether the other
   one is typical or not (all but some pairs in 10^5 right at the threshold).
4. Typical documents, again only in different components, are compared through lists of their full sets: every list of up
   to HOT members, and, for pairs that share nothing there, longer lists by the prefix rule: rare shingles first, a
   document needs to show only the first n/4 + 1, of which those outside of long lists are known not to be shared; and
   for the first shingle that a pair shares, both must have enough shingles after it to reach the threshold. So a passage that many
   documents share does not pair them, and neither does a text with thousands of loose variants; no list is cut off.
5. Components of the links: large-star and small-star rounds, each written to the shared folder.

Sketch filters lie more than four and a half standard deviations below the threshold, so all but a few links in a million
right at the threshold pass them. With exact=True nothing is left to chance: every document is typical and no sketch
filters, at the price of full-set lists for all. Sets are not kept: they are made
again for documents in pairs, picked by a bitmap of fixed size before anything is shuffled.

Defined cases: null, empty and blank texts have empty sets and link with nothing; fewer words than five are one shingle;
rows with equal doc_ids are one node, to which each row's set is linked; a null doc_id links with nothing, its
component_id is null and it is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, mix64, small_batches, table, utf8

SKETCH, HOT = 64, 16
#: A document with fewer of its sketch's values than this share in short lists takes part in long ones, too.
RARE = 0.5
WORDS, PERCENT = 5, 75
#: Bytes of text that are hashed at once.
BYTES = 512 << 10
#: Bits of the bitmap of documents to be verified; a prime, so that regular ids spread.
BITMAP = (1 << 24) - 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles, as signed numbers in the order of the hashes."""
    raw, offs = utf8(texts)
    n_docs = len(texts)
    if not len(raw):
        return [np.zeros(0, np.int64)] * n_docs
    raw = _LOWER[raw]
    space = _SPACE[raw]
    some = np.flatnonzero(np.diff(offs) > 0)
    first, last = space.copy(), space.copy()
    first[1:], last[:-1] = space[:-1], space[1:]
    first[offs[some]] = True
    last[offs[some + 1] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    if not len(starts):
        return [np.zeros(0, np.int64)] * n_docs
    lens = ends - starts
    at = np.cumsum(lens) - lens
    solid = raw[~space].astype(np.uint64)
    key = mix64(np.arange(1, int(lens.max()) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        word = mix64(np.add.reduceat((solid + np.uint64(1)) * key[np.arange(len(solid)) - np.repeat(at, lens)], at) + lens.astype(np.uint64))
        count = np.bincount(np.searchsorted(offs, starts, side="right") - 1, minlength=n_docs)
        rolled = word * _PLACE[0]
        for k in range(1, WORDS):
            rolled[:-k] += word[k:] * _PLACE[k]
    top = np.uint64(1 << 63)
    hashed = (mix64(rolled) ^ top).view(np.int64)
    out, w = [], 0
    for n in count.tolist():
        if n >= WORDS:
            out.append(np.unique(hashed[w : w + n - WORDS + 1]))
        elif n:
            with np.errstate(over="ignore"):
                whole = (word[w : w + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append((mix64(np.array([whole])) ^ top).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        w += n
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.diff(utf8(batch.column("text"))[1])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            sets = shingles(part.column("text"))
            keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), _lists([s[:SKETCH] for s in sets])],
                ["doc_id", "n", "k1", "k2", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch], bitmap: bytes) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(bitmap, np.uint8)
    for batch in batches:
        h = np.mod(batch.column("doc_id").to_numpy(zero_copy_only=False), BITMAP)
        batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7) & 1).astype(bool)))
        for part in _slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(shingles(part.column("text")))], ["id", "full"])


def bitmap_of(ids: DataFrame) -> bytes:
    """A bitmap of BITMAP bits (2 MB, whatever the input) of the column `id`; sums are made on the executors."""
    h = F.pmod(F.col("id"), F.lit(BITMAP)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(h).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("m")).collect()
    out = bytearray((BITMAP // 32768 + 1) * 4096)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out)


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch does not speak clearly against them."""
    one, two = (sketches.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = both.withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))
    s = F.size("u").cast("double")
    return both.where(shared >= s * PERCENT / 100 - F.when(s < SKETCH, F.lit(0.0)).otherwise(4.5 * F.sqrt(s * PERCENT * (100 - PERCENT) / 10000))).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    pairs = materialize(pairs, "dedup-pairs")
    bitmap = bitmap_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    full = docs.where("doc_id is not null").mapInArrow(partial(_sets, bitmap=bitmap), "id long, full array<long>")
    both = pairs.join(full.withColumnsRenamed({"id": "a", "full": "fa"}), "a").join(full.withColumnsRenamed({"id": "b", "full": "fb"}), "b")
    inter = F.size(F.array_intersect("fa", "fb"))
    return both.where(inter > 0).where(100 * inter >= PERCENT * (F.size("fa") + F.size("fb") - inter)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for all ends of the edges (a, b): root is the smallest id reachable."""
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "dedup-edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
    before = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b > m").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()
        now = materialize(small, "dedup-edges")
        if (after := mark(now)) == before:
            break
        before = after
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).union(now.select("a", F.col("a").alias("root")).distinct())


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2, sketch, written once."""
    return materialize(docs.mapInArrow(_sketch, "doc_id long, n long, k1 long, k2 long, sketch array<long>"), "dedup-sketches", compression="zstd")


def similar_sizes():
    """For sets whose sizes alone allow the threshold."""
    return 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")


def open_pairs(own: DataFrame, condition) -> DataFrame:
    """Pairs a < b of members of one list v in different components, from rows (v, rep, root, ...); every other column
    comes twice, with _a and _b. Lists within one component go before the join."""
    open_ = materialize(own.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("v"), "dedup-open")
    own = own.join(open_, "v")
    rest = [c for c in own.columns if c not in ("v", "rep")]
    one, two = (own.select("v", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rest]) for x in "ab")
    return one.join(two, "v").where("a < b and root_a <> root_b").where(condition)


def typical_pairs(docs: DataFrame, typical: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates among documents of which most shingles are in long lists, from their full sets."""
    bitmap = bitmap_of(typical.select(F.col("rep").alias("id")))
    full = docs.where("doc_id is not null").mapInArrow(partial(_sets, bitmap=bitmap), "id long, full array<long>")
    full = full.withColumn("n", F.size("full").cast("long")).join(typical.select(F.col("rep").alias("id")), "id").join(parts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    posts = full.select(F.col("id").alias("rep"), "n", F.coalesce("root", "id").alias("root"), F.explode("full").alias("v")).distinct()
    lists = materialize(posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "dedup-full-counts")
    posts = materialize(posts.join(lists, "v"), "dedup-full-lists", compression="zstd")
    rare = open_pairs(posts.where(F.col("c") <= HOT).select("v", "rep", "n", "root"), similar_sizes()).select("a", "b").distinct()

    long_ = posts.where(F.col("c") > HOT)
    here = Window.partitionBy("rep")
    long_ = long_.withColumn("h", F.count("*").over(here)).where(100 * F.col("h") >= PERCENT * F.col("n"))
    shown = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1 - (F.col("n") - F.col("h"))
    long_ = long_.withColumn("k", F.row_number().over(here.orderBy("c", "v"))).where(F.col("k") <= shown)
    # with what comes after a value that is the first that two sets share (in the order of lists' lengths), it must be enough
    after = (F.col("h") - F.col("k")).alias("after")
    most = 1 + F.least("after_a", "after_b")
    enough = most * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    return rare.union(open_pairs(long_.select("v", "rep", "n", "root", after), similar_sizes() & enough).select("a", "b").distinct())


def links(docs: DataFrame, base: DataFrame, classes: DataFrame, exact: bool = False) -> DataFrame:
    """(id, root) of the representatives that are linked with others."""
    live = base.where("n > 0 and doc_id is not null")
    reps = live.join(classes.select(F.col("rep"), "k1", "k2"), [live["doc_id"] == F.col("rep"), live["k1"] == classes["k1"], live["k2"] == classes["k2"]])
    reps = materialize(reps.select("rep", "n", "sketch").distinct(), "dedup-reps", compression="zstd")
    posts = reps.select("rep", "n", F.explode("sketch").alias("v"))
    # tables that are made by value are written before rows meet them by value: adaptive execution can then split a join
    # at a value that a great part of all rows has, which it cannot do with an aggregation on one side
    lists = materialize(posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "dedup-counts")
    posts = materialize(posts.join(lists, "v"), "dedup-lists", compression="zstd")
    hot = posts.groupBy("rep").agg(F.count_if(F.col("c") > HOT).alias("hot"), F.least(F.lit(SKETCH), F.max("n")).alias("k"))
    hot = materialize(hot.select("rep", "hot", (F.lit(exact) | (F.col("hot") > F.col("k") * (1 - RARE))).alias("typical")), "dedup-hot")

    posts = posts.join(hot, "rep")
    pivots = materialize(posts.groupBy("v").agg(F.max_by("rep", F.struct("hot", -F.col("rep"))).alias("m")), "dedup-pivots")
    meets = posts.join(pivots, "v").where("rep <> m").groupBy("rep", "m").agg(F.count("*").alias("o"), F.min("n").alias("n")).where(F.col("o") * 6 >= F.least(F.lit(SKETCH), F.col("n")))
    best = meets.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("o"), "m"))), 1, 2).alias("m"))
    stars = best.select("rep", F.explode("m.m").alias("m")).select(F.least("rep", "m").alias("a"), F.greatest("rep", "m").alias("b")).distinct()
    near = materialize(verified(estimated(stars, reps), docs), "dedup-links")
    parts = materialize(components(near), "dedup-components")

    own = posts.where(F.col("c") <= HOT).join(parts, F.col("rep") == F.col("id"), "left")
    own = own.select("v", "rep", "n", "hot", F.coalesce("root", "rep").alias("root"))
    pairs = open_pairs(own, similar_sizes()).groupBy("a", "b").agg(F.count("*").alias("o"), F.min(F.least("n_a", "n_b")).alias("n"), F.min(F.least("hot_a", "hot_b")).alias("h"))
    pairs = pairs.where(F.col("o") + F.col("h") >= F.least(F.lit(SKETCH), F.col("n")) * 0.42).select("a", "b")
    if exact:
        more = verified(typical_pairs(docs, reps.select("rep"), parts).distinct(), docs)
    else:
        more = verified(estimated(pairs.union(typical_pairs(docs, reps.join(hot.where("typical"), "rep"), parts)).distinct(), reps), docs)
    rows = live.join(classes, ["k1", "k2"]).select("doc_id", "rep").distinct()
    ties = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_hi")).where("a < _hi")  # ids with several texts
    ties = rows.join(ties, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    return components(near.union(more).union(ties))


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. One row for each row of docs."""
    docs = docs.select("doc_id", "text")
    base = sketched(docs)
    live = base.where("n > 0 and doc_id is not null")
    classes = materialize(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    ends = links(docs, base, classes, exact)
    root = classes.join(ends, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    same = live.join(root, ["k1", "k2"]).groupBy("doc_id").agg(F.min("root").alias("root"))  # rows with equal ids are one node
    same = same.where("root < doc_id")
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(same, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id")).drop("root")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays. What goes, the lesser part, is taken away from the documents.

    Of the rows with one doc_id, which are one node, one row stays: the first by hashes of its text, language and source.
    Rows without a doc_id have no place in components; of those with equal texts (null: a text of its own) one stays.
    Empty texts are linked with nothing and stay. An empty table stays empty; other columns pass, whatever they are called."""
    small_batches(spark)
    found = materialize(near_duplicates(docs), "dedup-found")
    often = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_often"))
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "dedup-gone")
    left = _without(docs.where("doc_id is not null"), gone, found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")))
    often = materialize(often, "dedup-often")  # of known size: mostly empty
    alone = left.join(often, left["doc_id"] == often["_often"], "left_anti")
    several = left.join(often, left["doc_id"] == often["_often"], "left_semi")
    return alone.unionByName(_one_of(several, [F.col("doc_id")])).unionByName(_one_of(docs.where("doc_id is null"), _text_key()))


def _place(c):
    """A place in a bitmap, from 1: other than pmod(), it does not follow the order of ids."""
    return F.pmod(F.xxhash64(c), F.lit(BITMAP)) + 1


def _marked(rows: DataFrame, id_, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose id, hashed, is (left_semi) or is not (left_anti) marked in a bitmap of BITMAP bits of the single column
    `ids`. The bitmap, of fixed size, goes to the rows; none of those is dealt anew."""
    h = _place(F.col(ids.columns[0]))
    bits = ids.groupBy(F.bitmap_bucket_number(h).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_m"))
    h = _place(id_)
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(bits["_m"], F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(h) == bits["_b"]) & (F.getbit(byte, (at % 8).cast("int")) == 1), how)


def _without(rows: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose doc_id is in `kept`, not in `gone` (single columns, which hold all ids of the rows between them).

    Whole texts are not dealt by id: rows that a bitmap of what goes does not mark stay where they are. Of the others, only
    those that a bitmap of marked ones that stay marks, too, are told apart by a join: a few, or as many as stay if the
    bitmaps fill up, with the same outcome."""
    id_ = rows["doc_id"]
    doubtful = materialize(_marked(kept, kept["_kept"], gone, "left_semi"), "dedup-doubtful")
    few = _marked(_marked(rows, id_, gone, "left_semi"), id_, doubtful, "left_semi")
    return _marked(rows, id_, gone, "left_anti").unionByName(few.join(gone, id_ == gone["_gone"], "left_anti"))


def _text_key() -> list:
    """128 bits of a text."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


def _one_of(rows: DataFrame, key: list) -> DataFrame:
    """One whole row for each key, summed up before anything is dealt by it."""
    order = F.struct(*_text_key(), "lang", "source")
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    one = rows.select(F.struct(*rows.columns).alias("_row"), order.alias("_order"), *named).groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.min_by("_row", "_order").alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns])
