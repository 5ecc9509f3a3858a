"""Language identification by compression: a text belongs to the language whose zstandard raw-content dictionary
encodes it in the fewest bytes.

Texts are lower-cased, runs of anything but letters become one space, and the rest is encoded in chunks of CHUNK bytes,
each against every dictionary, so that a long text keeps leaning on the dictionaries and not on its own beginning; all
chunks count. The dictionaries are bounded samples of labelled texts: for each of the LANGS most frequent languages at
most DICT_BYTES, from the first DOC_CHARS characters of at most DICT_DOCS documents, those with the smallest hashes. These
bounds hold for learning alone; every text is judged whole.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; languages of equal size go to the
alphabetically first and are rejected as narrow; null labels and texts teach nothing; without any labelled text, all is
`und`; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

#: The bounds of the sample that the dictionaries are made of.
DICT_BYTES, DICT_DOCS, DOC_CHARS, LANGS = 64 << 10, 64, 2 << 10, 256
CHUNK = 4096
#: A text is rejected if the second smallest encoding is not larger than the smallest by this share.
MARGIN = 0.004
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode()


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of (doc_id, text, lang). Counts first, then reads the few documents whose hash is small."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang", F.xxhash64(F.lit(7), "doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return {}
    share = lambda n: min(1.0, 8 * DICT_DOCS / n)
    low = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(-(2**63) + share(n) * (2**64 - 1) * 0.999999) if share(n) < 1 else 2**63 - 1))])
    picked = known.where(F.col("h") <= F.try_element_at(low, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = picked.select("lang", "h", "doc_id", F.substring("text", 1, DOC_CHARS).alias("text")).withColumn("k", F.row_number().over(first)).where(f"k <= {DICT_DOCS}").collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + letters(r["text"]) + b" ")[:DICT_BYTES]
    return out


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0)
    return [(lang, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)) for lang, d in sorted(dictionaries.items())]


def judge(text: str | None, packers: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected. Score: the margin between the two smallest sizes, 10 % or more being 1."""
    if not packers or text is None or not LETTER.search(text):
        return "und", 0.0, True
    raw = letters(text)
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in packers)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], min(1.0, 10 * margin), margin < MARGIN


def _judge(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    packers = compressors(dictionaries)
    for batch in batches:
        found = [judge(t, packers) for t in batch.column("text").to_pylist()]
        lang, score, out = zip(*found, strict=True) if found else ((), (), ())
        columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id alone if not given; `text` may be one of them) with lang_pred, score and rejected."""
    keep = keep or ["doc_id"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_judge, dictionaries=dictionaries), f"{schema}, lang_pred string, score double, rejected boolean").select(*keep, "lang_pred", "score", "rejected")


def training(docs: DataFrame) -> DataFrame:
    """What may be learned from: all but the held-out quarter."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(training(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def _clear(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    packers = compressors(dictionaries)
    for batch in batches:
        yield batch.filter(pa.array([not judge(t, packers)[2] for t in batch.column("text").to_pylist()], pa.bool_()))


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear.

    Rows pass whole, whatever their columns are called. A null or empty text, or one without a letter, is not clear and
    goes; null ids and repeated rows are judged by their texts like all others; an empty table stays empty."""
    small_batches(spark)
    return docs.mapInArrow(partial(_clear, dictionaries=learn(training(docs))), docs.schema)
