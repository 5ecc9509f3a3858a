import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import zstandard

import corpus_pipeline
from tidemark.llm import dedup, langid, mixture, pieces, quality

from .conftest import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component of every id, from all pairs that share a shingle; rows with equal ids are one node."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    where, up = defaultdict(list), {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, (i, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                up[b] = a
    return {i: root(i) for i in up}


def check(frame, exact=False):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = dedup.near_duplicates(frame, exact).collect()
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((i is None, i or 0, len(shingle_set(t))) for i, t in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return want


def test_shingles_equal_sets(docs_pd):
    texts = [*docs_pd.text, None, "", " ", "a b c d", "A B\tc\x0bd", "a b c d e", "a b c d e a b c d e", "É a a a a a"]
    got = dedup.shingles(pa.array(texts))
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts]
    assert got[-5].tolist() == got[-4].tolist()
    a, b = (dedup.shingles(pa.array([t, "q"])[:1] if k else pa.array(["zz", t])[1:])[0] for k, t in enumerate(["the same text in two places of a batch"] * 2))
    assert a.tolist() == b.tolist()


def test_dedup_equals_brute_force(spark, docs, odd_docs, no_docs):
    check(docs)
    check(docs, exact=True)
    check(odd_docs)
    assert dedup.near_duplicates(no_docs).count() == 0


def test_dedup_of_hot_groups(spark):
    """Many near copies, many documents with one shared passage, chains of edits, ids with several texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(40)], []
    seed = [word() for _ in range(150)]
    for _ in range(160):  # near copies
        w = list(seed)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for n in (5, 20, 60, 150):  # a shared passage, as the larger or the smaller part
        rows += [" ".join(passage + [word() for _ in range(n)]) for _ in range(90)]
    w = [word() for _ in range(120)]
    for _ in range(40):  # a chain whose ends have little in common
        w = list(w)
        w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [rows[0]] * 100 + [rows[170]] * 30
    rng.shuffle(rows)
    data = [*enumerate(rows), (3, rows[50]), (7, rows[500]), (7, "just some words")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = check(frame)
    assert len(set(want.values())) < len(want) / 2
    check(frame, exact=True)


def test_dedup_of_typical_and_other_documents(spark):
    """Documents made of passages that many share, and near copies of them with a fifth of new text: pairs at the threshold
    of which one side lies in long lists almost wholly and the other one does not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    parts, rows = [[word() for _ in range(60)] for _ in range(6)], []
    for _ in range(40):
        rows.append(" ".join(w for p in rng.sample(parts, 4) for w in p))
    for n in (60, 70, 76, 80):
        base = [w for p in rng.sample(parts, 4) for w in p]
        rows += [" ".join(base), " ".join(base + [word() for _ in range(n)])]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {(r.id, r.root) for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (150, 100), (200, 100)}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(held_out)).all() and got.score.between(0, 1).all()
    test = got[got.held_out & (got.n_chars >= 100)]
    assert (test.lang == test.lang_pred).mean() > 0.97 and test.rejected.mean() < 0.01


def test_language_learns_only_from_its_part(docs):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert langid.learn(langid.training(docs)) == langid.learn(langid.training(other))


def plain_verdict(text, model):
    """By hand: letters in lower case, chunks, one compressor for each language."""
    raw = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not raw:
        return "und", 0.0
    lead = " " if not re.match(r"[^\W\d_]", text.lower()) else ""
    tail = " " if not re.search(r"[^\W\d_]$", text.lower()) else ""
    data = (lead + raw + tail).encode()
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0)
    sizes = {}
    for lang, d in model.items():
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
        sizes[lang] = sum(len(packer.compress(data[k : k + 4096])) for k in range(0, len(data), 4096))
    best, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
    return best[0], min(1.0, 10 * (1 - best[1] / second[1]))


def test_language_equals_sizes_by_hand(spark, docs, odd_docs):
    model = langid.learn(langid.training(docs))
    assert set(model) == {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    for frame in (docs, odd_docs):
        rows = langid.identify(frame, model, ["doc_id", "text"]).collect()
        assert len(rows) == frame.count()
        for r in rows:
            lang, score = plain_verdict(r.text or "", model)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-12 and (lang == "und" or r.rejected == (score / 10 < langid.MARGIN))


def test_language_sample_is_bounded(spark):
    rows = [(i, "wort " * 5000, f"l{i % 300:03d}") for i in range(600)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model) == langid.LANGS and all(len(d) <= min(langid.DICT_BYTES, 2 * langid.DOC_CHARS + 2) for d in model.values())


def test_language_odd_rows(spark, docs, odd_docs, no_docs):
    model = langid.learn(langid.training(docs))
    assert model and all(len(d) <= langid.DICT_BYTES for d in model.values())
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 10)} == {"und"} and all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.learn(no_docs) == {} and {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_pipeline(spark, odd_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_dedup", "mix", "pieces"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.materialize(stage(spark, docs, sf), "test-stage")
        assert k == 4 or after.columns == docs.columns
        ids = set(after.toPandas().doc_id)
        assert ids <= set(docs.toPandas().doc_id) and len(ids) > 0.7 * docs.count()
        if k == 2:
            want = brute([(r.doc_id, r.text) for r in docs.collect()])
            assert ids == set(want.values())
        docs = after
    assert docs.columns == ["doc_id", "lang", "source", "n_chars", "ids"]


def survivors(stage, rows, spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, g string, _row int"
    frame = spark.createDataFrame([(i, t, "en", "src0", 0, 1, "x", 2) for i, t in rows], schema)
    out = stage(spark, frame, "")
    assert out.columns == frame.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def clean(k, n=120):
    rng = random.Random(k)
    return " ".join("".join(rng.choices("aeioubcdflmnrst", k=rng.randrange(3, 9))) for _ in range(n))


def test_quality_judges_each_row_by_itself(spark):
    good, again = clean(1), clean(2)
    assert survivors(quality.stage_quality, [(None, good), (None, "short"), (None, None), (5, again), (5, "short"), (6, "")], spark) == sorted([(None, good), (5, again)], key=str)
    assert survivors(quality.stage_quality, [(7, good), (7, good)], spark) == [(7, good)] * 2


def test_near_dedup_keeps_one_row_of_each(spark):
    a, b, c = clean(1), clean(2), clean(3)
    assert survivors(dedup.stage_near_dedup, [(1, a), (1, a)], spark) == [(1, a)]
    assert survivors(dedup.stage_near_dedup, [(1, a), (2, a), (2, b), (3, b), (4, c)], spark) == [(1, a), (4, c)]
    got = survivors(dedup.stage_near_dedup, [(1, a), (1, b), (2, c)], spark)
    assert len(got) == 2 and got[0] in [(1, a), (1, b)] and got[1] == (2, c)
    assert survivors(dedup.stage_near_dedup, [(None, a), (None, a), (None, b), (None, None), (None, None), (3, ""), (4, "")], spark) == sorted([(None, a), (None, b), (None, None), (3, ""), (4, "")], key=str)
    hot = [(9, a)] * 50 + [(9, b)] * 30 + [(8, b)]
    assert survivors(dedup.stage_near_dedup, hot, spark) in ([(8, b)],)


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_dedup_leaves_texts_where_they_are(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789      ", k=40_000)) for _ in range(60)]
    frame = spark.createDataFrame([(k, texts[k % 60], "en", "src0") for k in range(75)], "doc_id long, text string, lang string, source string").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than are sent to all executors
    try:
        frame = dedup.materialize(frame, "test-docs")
        out = dedup.stage_near_dedup(spark, frame, None)
        before = shuffled(spark)
        assert sorted(r.doc_id for r in out.collect()) == list(range(60))
        assert shuffled(spark) - before < 0.1 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_that_go_when_bitmaps_are_full(spark, monkeypatch):
    for size in (1, 7, 61, dedup.BITMAP):
        monkeypatch.setattr(dedup, "BITMAP", size)
        rows = spark.range(200).selectExpr("id - 50 AS doc_id", "repeat('x', 1) AS text", "5 AS _b", "'y' AS _m", "6 AS _gone", "7 AS _kept")
        gone, kept = (spark.range(200).where(f"{no} (id % 9 = 3)").select((F.col("id") - 50).alias(name)) for no, name in (("", "_gone"), ("NOT", "_kept")))
        out = dedup._without(rows, gone, kept)
        assert out.columns == rows.columns
        assert sorted(r.doc_id for r in out.collect()) == [k - 50 for k in range(200) if k % 9 != 3]
        none = gone.where("false")
        assert dedup._without(rows, none, rows.select(F.col("doc_id").alias("_kept"))).count() == 200


def test_other_stages_treat_rows_alike(spark):
    a = clean(1)
    assert survivors(mixture.stage_mix, [], spark) == []
    got = survivors(langid.stage_language_id, [(None, a), (1, a), (1, a), (2, None), (3, "12 !")], spark)
    assert set(got) <= {(None, a), (1, a)}
    frame = spark.createDataFrame([(1, a, 3), (1, a, 3), (None, None, 4)], "doc_id long, text string, ids int")
    rows = pieces.stage_pieces(spark, frame, "").collect()
    assert len(rows) == 3 and rows[0].ids == rows[1].ids and rows[2].ids == []


def test_stages_odd_rows(spark, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "").toPandas()
            assert isinstance(out, pd.DataFrame) and len(out) <= frame.count() and (len(out) == 0 or np.isin(out.doc_id.dropna(), [*range(11)]).all())
