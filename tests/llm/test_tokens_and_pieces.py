import base64
import glob
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import pieces, token_store
from tidemark.llm.common import shared_dir

from .conftest import by_id

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def stored(spark, docs):
    path = shared_dir(spark, "test-tokens")
    token_store.write_tokens(docs, path, PATH)
    return path


def test_token_store_equals_brute_force(spark, docs, docs_pd):
    path = stored(spark, docs)
    got = [tuple(r) for r in token_store.digests(spark, path).orderBy("doc_id").collect()]
    assert got == brute(docs_pd.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False))
    some = token_store.read_tokens(spark, path).where("doc_id = 17").collect()[0]
    assert (some.start, some.n_tokens) == got[17][1:3] and zlib.crc32(np.array(some.tokens, "<u4").tobytes()) == got[17][3]
    plan = token_store.read_tokens(spark, path, with_tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan  # metadata reads leave the ids alone


def test_token_store_odd_rows(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = [tuple(r) for r in token_store.digests(spark, stored(spark, odd_docs)).orderBy("start").collect()]
    assert got == brute(rows)
    assert token_store.digests(spark, stored(spark, no_docs)).count() == 0


def ids_of(enc, texts):
    ids, n = enc.batch(pa.array(texts, pa.string()), 2)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_encoder_cuts_are_safe():
    enc = token_store.Encoder(PATH)
    texts = ["a  b", " x", "x ", "a\n b", "a \n\n b,c.\nD e's don't 3,4 1.5 ,, .. a.,b", "<|endoftext|> a b", "\u00e9\xa0b c", "a\x00b c", "", "x.\nAb, y", "tab\tb c", "\nA\nb.\n", "\x01", "a\x01 b", "\n", "\u65e5\u672c, \U0001f600. x\u0301, y", "1,2 x1.y a!? b", None]
    for _ in range(2):  # the second time from the cache
        assert ids_of(enc, texts) == [np.frombuffer(enc.whole(t or ""), "<u4").tolist() + [2] for t in texts]


def test_encoder_cuts_are_safe_for_random_texts():
    enc, rng = token_store.Encoder(PATH), np.random.default_rng(4)
    parts = [" ", " ", "\n", "a", "Word", "\u00e9t\u00e9", "12", ",", ".", "'", "'s", "-", "\t", "\u00a0", "\u0303", "\u65e5", "!?", "\x00", "\x01", "<|endoftext|>", "||"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    assert ids_of(enc, texts) == [np.frombuffer(enc.whole(t), "<u4").tolist() + [2] for t in texts]


def test_encoder_of_another_kind_goes_whole():
    enc = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some Words, and MORE.", "", "a  b\nc"]
    assert not enc.cuts and ids_of(enc, texts) == [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_blocks_keep_rows_and_bound_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "BYTES", 100)
    texts = ["x" * n for n in (10, 95, 5, 300, 1, 0, 99, 50, 51)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for size in (1, 3, 10):
        got = [b.column("text").to_pylist() for b in token_store._blocks(batch.slice(k, size) for k in range(0, len(texts), size))]
        assert [t for b in got for t in b] == texts and all(sum(len(t or "") for t in b) <= 100 or len(b) == 1 for b in got)


def test_token_store_layout(spark, docs):
    """The footers: delta pages for the metadata, dictionary pages for the ids, bounded row groups, page indexes."""
    path = stored(spark, docs).removeprefix("file://")
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    assert files
    for name in files:
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 40 << 20
            columns = {c.path_in_schema.split(".")[0]: c for c in map(group.column, range(group.num_columns))}
            for c in columns.values():
                assert c.has_offset_index and c.has_column_index and c.compression == "ZSTD"
            for c in ("doc_id", "part", "local_start", "n_tokens"):
                assert {"DELTA_BINARY_PACKED"} <= set(columns[c].encodings) or c == "part"
            assert "RLE_DICTIONARY" in columns["tokens"].encodings


TEXTS = ["a b c", "  a   b ", "", "a\x00b c\x00", "\u2581x \u2581", "\u65e5\u672c\u8a9e text \U0001f600", "\n\n a\n", "x" * 50 + " y" * 20, "the quick brown fox jumps over the lazy dog"]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6, 1.0])
def test_pieces_are_lossless(rate):
    m = pieces.model(pieces.production_model())
    ids, n = m.encode(pa.array(TEXTS), np.arange(len(TEXTS)), rate, 3, 8)
    raw, at = m.decode(ids, n)
    assert [raw.tobytes()[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == TEXTS


def test_pieces_without_dropout_equal_the_library(docs_pd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.production_model())
    texts = [*docs_pd.text.fillna("")[:60], "  a   b ", "\n\n a\n", "x" * 50 + " y" * 20]
    m = pieces.model(pieces.production_model())
    ids, n = m.encode(pa.array(texts), np.arange(len(texts)), 0.0, 3, 8)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(texts)


def test_dropout_equals_a_plain_agenda():
    """The batched rounds against one unit at a time: pop the best candidate, skip it for good if its hash says so."""
    m, rate = pieces.model(pieces.production_model()), 0.4
    words = [" the", " unbelievable", " interesting", " a", " \u00e9l\u00e8ve", " zzzz"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lens = np.array([len(w) for w in words])
    key = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(977)
    got, counts = m.merge(points, lens, key, rate)
    bound = np.uint64(int(rate * 2.0**64))
    at = 0
    for w, word in enumerate(words):
        syms = [(i, int(m.char[ord(c)]) if m.char[ord(c)] >= 0 else -1 - ord(c)) for i, c in enumerate(word)]
        while True:
            best = None
            for k in range(len(syms) - 1):
                piece = int(m.pair(np.array([syms[k][1]]), np.array([syms[k + 1][1]]))[0])
                if piece < 0:
                    continue
                with np.errstate(over="ignore"):
                    h = pieces.mix64(key[w : w + 1] + np.uint64(syms[k][0]) * np.uint64(0x9E3779B97F4A7C15) ^ np.array([piece], np.uint64) << np.uint64(40))[0]
                if h >= bound and (best is None or m.rank[piece] < m.rank[best[1]]):
                    best = (k, piece)
            if best is None:
                break
            syms[best[0] : best[0] + 2] = [(syms[best[0]][0], best[1])]
        assert got[at : at + counts[w]].tolist() == [s for _, s in syms]
        at += counts[w]


def test_dropout_varies_and_is_seeded(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("interesting unbelievable considerations").alias("text"))
    once = by_id(pieces.encode_checked(docs, pieces.production_model(), rate=0.3))
    again = by_id(pieces.encode_checked(docs.repartition(7), pieces.production_model(), rate=0.3))
    other = by_id(pieces.encode_checked(docs, pieces.production_model(), rate=0.3, seed=5))
    ids = lambda x: [tuple(v) for v in x.ids]
    assert once.lossless.all() and ids(once) == ids(again) and ids(once) != ids(other) and len(set(ids(once))) > 5


def test_dropout_draws_every_occurrence_anew():
    """Equal texts under many numbers, and one word at many places, have many more than a handful of segmentations."""
    m = pieces.model(pieces.production_model())
    ids, n = m.encode(pa.array(["interesting unbelievable considerations"] * 2000), np.arange(2000), 0.1, 17)
    assert len({tuple(x.tolist()) for x in np.split(ids, np.cumsum(n)[:-1])}) > 100
    word = m.encode(pa.array([" ".join(["unbelievable"] * 2000)]), np.array([3]), 0.1, 17)[0]
    starts = np.flatnonzero(m.piece_bytes[m.piece_start[word]] == 32)
    assert len(starts) == 2000 and len({tuple(x.tolist()) for x in np.split(word, starts[1:])}) > 16


def test_long_units_equal_short_ones():
    """The heap against the rounds, on both sides of the limit, and a megabyte without a space in seconds."""
    m, rng = pieces.model(pieces.production_model()), np.random.default_rng(9)
    for rate in (0.0, 0.2, 1.0):
        for text in ("".join(rng.choice(list("abcdeinrstu\u00e9\u65e5"), n)) for n in (2, 64, 65, 400)):
            points, key = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([2**63 + len(text)], np.uint64)
            assert m.merge(points, np.array([len(text)]), key, rate)[0].tolist() == m.merge_long(points, int(key[0]), rate).tolist()
    texts = ["ab " + "x" * 70_000 + " cd " + "interesting" * 30, "none", "y" * 65]
    ids, n = m.encode(pa.array(texts), np.arange(3), 0.1, 3)
    raw, at = m.decode(ids, n)
    assert [raw.tobytes()[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts
    big = base64.b64encode(rng.bytes(750_000)).decode()
    start = time.process_time()
    ids, n = m.encode(pa.array([big]), np.arange(1), 0.1, 3)
    assert m.decode(ids, n)[0].tobytes().decode() == big and time.process_time() - start < 20


def test_pieces_odd_rows(odd_docs, no_docs):
    got = pieces.encode_checked(odd_docs, pieces.production_model()).toPandas()
    assert len(got) == odd_docs.count() and got.lossless.all() and (got[got.doc_id == 1].n_ids == 0).all()
    assert pieces.encode_checked(no_docs, pieces.production_model()).count() == 0
    back = pieces.decode(pieces.encode(odd_docs, pieces.production_model()), pieces.production_model()).toPandas()
    assert (back.decoded == back.text.fillna("")).all()
