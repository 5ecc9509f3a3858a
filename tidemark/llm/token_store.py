"""Token ids in Parquet: list columns with dictionary pages for the ids and delta encoding for the metadata, small row
groups and pages with page indexes, so that a reader can fetch the metadata alone or the tokens of a few documents.

Layout: one file for each range of doc_id, ascending; each row has `part` (the range's number), `local_start` (ids before
it in its part), `n_tokens` and `tokens`. A second folder, `index`, has for each part the ids of all parts before it, so
the position of a document in the corpus is base(part) + local_start and no writer has to wait for another.

Defined cases: a null text counts as empty and gives the end id alone; repeated doc_ids are kept, ordered by text; a null
doc_id sorts first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_base, shared_dir, table

TOKENS = "doc_id long, part long, local_start long, n_tokens long, tokens array<int>"
#: Row groups of 32 MB, pages of 64 KB or 1000 rows: page indexes then let a reader skip to a few documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Before a single space between two non-spaces, around a single line feed, and between a letter or digit and a mark, a
#: byte-level pre-tokenizer always begins a new piece, whatever follows.
CUT = re.compile(r"(?<=\S)(?= \S)").split
MARKS = r"([A-Za-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}])([,.!?;:])"
#: White space next to white space, or other than space and line feed, or at an end, and what the cutting itself puts in:
#: such texts are cut by CUT alone. (For Arrow's regular expressions, whose own white space is ASCII.)
_RARE = r"\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"[ \n{_RARE}][ \n{_RARE}]|[{_RARE}\x{{0}}\x{{1}}]|^ | $"
#: Pieces that can stand one after the other without changing: one space, then no white space.
JOINS = re.compile(r" \S+").fullmatch
END = "\x01"
#: Entries of a generation of the cache, bytes of text at once, and new pieces in one call of the tokenizer.
CACHE, BYTES, PIECES = 400_000, 8 << 20, 5_000
#: Rows of a batch that goes back.
ROWS = 1000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Whole texts through a tokenizers file. Where the file's kind is byte-level BPE with the usual pattern, pieces between
    safe cuts are encoded once and kept as little-endian bytes; texts with special tokens in them, and all texts of files
    of another kind, go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [x.content for x in added.values()]
        self.cuts = self._is_byte_level() and not any(re.search(r"\s", x) for x in self.specials)
        if self.cuts:
            # every character of a token stands for one byte
            self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
            self.tokenizer.model._resize_cache(0)  # no piece comes twice
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before: what is still in use moves over

    def _is_byte_level(self) -> bool:
        how = json.loads(self.tokenizer.to_str())
        pre = how.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        model = how.get("model") or {}
        bpe = model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        return bool(plain and bpe) and how.get("normalizer") is None and how.get("truncation") is None and how.get("padding") is None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """New pieces: those that can stand in a row go to the library as one text, and the tokens' lengths say where each
        one ends; the others go as texts of their own."""
        row = [x for x in pieces if JOINS(x)]
        for k in range(0, len(row), PIECES):
            some = row[k : k + PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter((len(x.encode()) for x in some), np.int64, len(some)))) + 1
            at, raw = [0, *(ends * 4).tolist()], ids.tobytes()
            self.cache.update(zip(some, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        if len(row) < len(pieces):
            rest = [x for x in pieces if not JOINS(x)]
            for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.cache[x] = np.array(e.ids, "<u4").tobytes()

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, from the cache or encoded now."""
        got = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(got) if x is None]
        if self.old:
            before = [(i, x) for i in new if (x := self.old.get(pieces[i])) is not None]
            for i, x in before:
                self.cache[pieces[i]] = got[i] = x
            new = [i for i in new if got[i] is None]
        self.learn([pieces[i] for i in new])
        for i in new:
            got[i] = self.cache[pieces[i]]
        return got

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text's followed by `end_id`, and how many each has. Pieces are found and made distinct
        by Arrow; Python sees each once."""
        texts = pc.fill_null(texts, "")
        end = np.array([end_id], "<u4").tobytes()
        if not self.cuts:
            raw = [self.whole(t) + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(raw), "<i4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        marked = pc.replace_substring(pc.replace_substring(pc.replace_substring_regex(texts, MARKS, "\\1\x00\\2"), " ", "\x00 "), "\n", "\x00\n\x00")
        units = pc.split_pattern(pc.binary_join_element_wise(marked, END, "\x00"), "\x00")
        special = pa.array(np.zeros(len(texts), bool))
        for s in self.specials:
            special = pc.or_(special, pc.match_substring(texts, s))
        odd = pc.or_(special, pc.match_substring_regex(texts, ODD)).to_numpy(zero_copy_only=False)
        special = special.to_numpy(zero_copy_only=False)
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        self.cache |= {"": b"", END: end}
        lone = []
        if odd.any():
            rows = units.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                text = texts[i].as_py()
                if special[i] or "\x00" in text or END in text:
                    lone.append(f"{END}{i}")
                    self.cache[lone[-1]] = self.whole(text)
                    rows[i] = [lone[-1], END]
                else:
                    rows[i] = [*CUT(text), END]
            units = pa.array(rows, pa.list_(pa.string()))
        per = np.diff(units.offsets.to_numpy()).astype(np.int64)
        coded = units.flatten().dictionary_encode()
        raw = pa.array(self.known(_strings(coded.dictionary)), pa.large_binary())
        for name in lone:
            del self.cache[name]
        put = raw.take(coded.indices)
        _, offs, data = put.buffers()
        at = np.frombuffer(offs, np.int64)[: len(put) + 1][np.concatenate([[0], np.cumsum(per)])] // 4
        return np.frombuffer(data, "<i4")[at[0] : at[-1]], np.diff(at)


def _strings(names: pa.StringArray) -> list[str]:
    """to_pylist() for strings without a null character, in one split."""
    if not len(names):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
    return pc.binary_join(one, "\x00")[0].as_py().split("\x00")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about BYTES of text (but one row at least), whatever the batches are."""
    held: list[pa.RecordBatch] = []
    room = BYTES
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            n = int(np.searchsorted(ends[at:] - (ends[at - 1] if at else 0), room, side="right"))
            if n:
                held.append(batch.slice(at, n))
                room -= int(size[at : at + n].sum())
                at += n
            elif not held:
                yield batch.slice(at, 1)
                at += 1
            if at < batch.num_rows and held:
                yield pa.concat_batches(held)
                held, room = [], BYTES
    if held:
        yield pa.concat_batches(held)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, start, enc = TaskContext.get().partitionId(), 0, encoder(path)
    for block in _blocks(batches):
        values, n = enc.batch(block.column("text"), end_id)
        ends = np.cumsum(n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
        columns = [block.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(start + ends - n), pa.array(n), lists]
        whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "tokens"])
        yield from (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))
        start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode (doc_id, text) and write the store below `path`. One shuffle, of the texts, by ranges of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id), TOKENS).write.options(**LAYOUT).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    parts = spark.read.schema(TOKENS).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    prefix_base(parts, "part", "n").coalesce(1).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, with_tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, tokens; filters on doc_id reach the page index."""
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    index = spark.read.schema("part long, base long").parquet(f"{path}/index")
    kept = ["doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens"]
    return rows.join(index, "part").select(*kept, *["tokens"] * with_tokens)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        values, offs = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store, from its files."""
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens").mapInArrow(_digest, "doc_id long, part long, local_start long, n_tokens long, ids_crc32 long")
    index = spark.read.schema("part long, base long").parquet(f"{path}/index")
    return rows.join(index, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
