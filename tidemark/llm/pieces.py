"""SentencePiece BPE with seeded merge-dropout, and decoding.

A text is cut into units (spaces, then what follows up to the next space), since no piece of the model goes on past a
space. Each unit runs the usual agenda: the best-scored adjacent pair merges first, the leftmost among equals. With
dropout, a candidate is skipped for good when a keyed hash of (seed, doc_id, the unit's place in the document, its own
place in the unit, the merged piece) falls below the rate. So every occurrence of a word is drawn anew, within and across
documents; without dropout equal units are worked out once. numpy works on many units together: each round merges one
pair in every unit that has a candidate left. A unit of over LONG characters, which would need a round for each of its
merges, is worked out by itself with a heap and linked neighbours, to the same pieces: its time grows with n log n, its
memory with about a hundred bytes a character.

Decoding joins the pieces' bytes (byte pieces as bytes, spaces back), drops the space put before the text, and gives the
very bytes of the text for any rate: no normalisation is applied, and characters outside of the model, the space marker
itself included, go to byte pieces.

Defined cases: a null or empty text has no ids; a rate of 0 gives the library's own ids (for texts that its
normalisation leaves alone); equal texts under different doc_ids may differ in ids; a null doc_id counts as 0; repeated
rows get equal ids; empty tables give no rows; other columns are passed only if asked for.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import mix64, small_batches, spans, table, utf8

MARK = "\u2581"
#: Documents, bytes, and units that are worked on at once.
DOCS, BYTES, UNITS = 2000, 1 << 20, 12_000
#: Characters from which a unit is worked out by itself.
LONG = 64
NONE = np.int64(1 << 40)
NO_SYMBOL = -(1 << 40)

_models: dict[str, Model] = {}


class Model:
    """Tables of a SentencePiece BPE model: characters, valid pairs, scores, bytes of the pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.size = n
        by_text = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.byte0 = sp.piece_to_id("<0x00>")
        order = sorted({sp.get_score(i) for i in range(n)}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        rank = np.array([place[sp.get_score(i)] for i in range(n)], np.int64)
        self.mark = by_text[MARK]
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in by_text.items():
            if len(p) == 1 and p != MARK:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.mark
        pairs = {}
        for p, i in by_text.items():
            for k in range(1, len(p)):
                a, b = by_text.get(p[:k]), by_text.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.merged_of = np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.rank, self.ranks = rank, rank.tolist()
        bits = 1
        while (1 << bits) < 4 * len(keys):
            bits += 1
        self.bits = np.uint64(64 - bits)
        slots = np.full(1 << bits, -1, np.int64)  # open addressing; a slot holds the number of a key
        hashed = (mix64(keys.astype(np.uint64)) >> self.bits).astype(np.int64)
        self.probes = 1
        for k, h in enumerate(hashed.tolist()):
            d = 0
            while slots[(h + d) % len(slots)] >= 0:
                d += 1
            slots[(h + d) % len(slots)] = k
            self.probes = max(self.probes, d + 1)
        self.slots, self.keys = slots, keys
        self.pairs = pairs
        out = [bytes([i - self.byte0]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.piece_len = np.array([len(x) for x in out], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = (mix64(key.astype(np.uint64)) >> self.bits).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        for d in range(self.probes):
            s = self.slots[(at[left] + d) & (len(self.slots) - 1)]
            hit = (s >= 0) & (self.keys[s] == key[left])
            out[left[hit]] = self.merged_of[s[hit]]
            left = left[~hit & (s >= 0)]
            if not len(left):
                break
        return out

    def merge(self, codes: np.ndarray, lens: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units (code points, their counts) with a hash key for each unit: ids and their counts.
        An id below 0 is minus one minus a code point that has no piece."""
        sym = self.char[codes].astype(np.int64)
        sym = np.where(sym < 0, -1 - codes.astype(np.int64), sym)
        unit = np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(sym)) - np.repeat(np.cumsum(lens) - lens, lens)
        bound = np.uint64(min(2**64 - 1, int(rate * 2.0**64)))

        def score(at: np.ndarray, sym: np.ndarray, place: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For pairs that begin at `at`: sort key (smaller merges first) and merged piece."""
            piece = self.pair(sym[at], sym[at + 1])
            ok = piece >= 0
            if rate > 0:
                k = np.flatnonzero(ok)
                with np.errstate(over="ignore"):
                    h = mix64(key[unit[at[k]]] + place[at[k]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ piece[k].astype(np.uint64) << np.uint64(40))
                drop = h < bound
                ok[k[drop]] = False
            return np.where(ok, self.rank[piece] << 20 | np.minimum(place[at], (1 << 20) - 1), NONE), piece

        def pairs(unit: np.ndarray) -> np.ndarray:
            return np.flatnonzero(unit[1:] == unit[:-1]) if len(unit) else np.zeros(0, np.int64)

        best, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
        at = pairs(unit)
        best[at], made[at] = score(at, sym, place, unit)
        done_sym, done_unit = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            count = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(best, first)
            open_ = least < NONE
            if not open_.all():  # finished units leave
                stay = np.repeat(open_, count)
                done_sym.append(sym[~stay])
                done_unit.append(unit[~stay])
                sym, unit, place, best, made = sym[stay], unit[stay], place[stay], best[stay], made[stay]
                if not len(sym):
                    break
                count, least = count[open_], least[open_]
                first = np.cumsum(count) - count
            hit = np.flatnonzero(best == np.repeat(least, count))
            if len(hit) > len(first):  # places past the key's bits may tie: the leftmost
                hit = hit[np.searchsorted(hit, first)]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep) - 1
            hit = new_at[hit]
            sym, unit, place, best, made = sym[keep], unit[keep], place[keep], best[keep], made[keep]
            best[hit] = NONE
            right = hit[(hit + 1 < len(sym))]
            right = right[unit[right + 1] == unit[right]]
            before = hit[hit > 0] - 1
            before = before[unit[before] == unit[before + 1]]
            best[before] = NONE
            at = np.concatenate([right, before])
            if len(at):
                best[at], made[at] = score(at, sym, place, unit)
        sym = np.concatenate(done_sym) if done_sym else sym
        unit = np.concatenate(done_unit) if done_unit else unit
        order = np.argsort(unit, kind="stable")
        return sym[order].astype(np.int32), np.bincount(unit, minlength=len(lens)).astype(np.int64)

    def merge_long(self, codes: np.ndarray, key: int, rate: float) -> np.ndarray:
        """The symbols of one long unit: the agenda of merge() as a heap of (rank, place), with dead entries left in it."""
        n, size, pairs, rank = len(codes), self.size, self.pairs, self.rank
        start = self.char[codes].astype(np.int64)
        start = np.where(start < 0, -1 - codes.astype(np.int64), start)
        bound = min(2**64 - 1, int(rate * 2.0**64))
        piece = self.pair(start[:-1], start[1:])
        if rate > 0:
            k = np.flatnonzero(piece >= 0)
            with np.errstate(over="ignore"):
                h = mix64(np.uint64(key) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ piece[k].astype(np.uint64) << np.uint64(40))
            piece[k[h < np.uint64(bound)]] = -1
        some = np.flatnonzero(piece >= 0)
        heap = (rank[piece[some]] << 40 | some).tolist()
        heapq.heapify(heap)
        made = array("q", piece.tobytes())
        made.append(-1)
        sym, after, before = array("q", start.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        most = (1 << 64) - 1

        def weigh(at: int) -> None:
            """The candidate that begins at a place, anew."""
            right = after[at]
            found = -1
            if right < n and sym[at] >= 0 and sym[right] >= 0:
                found = pairs.get(sym[at] * size + sym[right], -1)
            if found >= 0 and rate > 0:
                x = (key + at * 0x9E3779B97F4A7C15 & most) ^ (found << 40 & most)
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
                x = (x ^ x >> 27) * 0x94D049BB133111EB & most
                if x ^ x >> 31 < bound:
                    found = -1
            made[at] = found
            if found >= 0:
                heapq.heappush(heap, ranks[found] << 40 | at)

        ranks = self.ranks
        while heap:
            entry = heapq.heappop(heap)
            at = entry & (1 << 40) - 1
            found = made[at]
            if found < 0 or ranks[found] != entry >> 40:
                continue
            gone = after[at]
            sym[at], made[gone], sym[gone] = found, -1, NO_SYMBOL
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            weigh(at)
            if before[at] >= 0:
                weigh(before[at])
        out = np.frombuffer(sym, np.int64)
        return out[out != NO_SYMBOL].astype(np.int32)

    def to_ids(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces."""
        bad = np.flatnonzero(sym < 0)
        if not len(bad):
            return sym, counts
        code = -1 - sym[bad]
        n = np.ones(len(sym), np.int64)
        n[bad] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(sym, n)
        raw = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out[out < 0] = raw.astype(np.int32) + self.byte0
        ends, c = np.cumsum(n), np.cumsum(counts)
        total = np.concatenate([[0], ends])[c]
        return out, np.diff(np.concatenate([[0], total]))

    def encode(self, texts: pa.Array, ids: np.ndarray, rate: float, seed: int, block: int = UNITS) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each has; `block` units are worked on at once."""
        texts = pc.fill_null(texts, "")
        some = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        full = texts.take(pa.array(some))
        # each unit begins with its spaces: a cut before every space whose predecessor is none
        marked = pc.replace_substring_regex(pc.binary_join_element_wise("", full, " "), r"([^ ]) ", "\\1\x00 ")
        odd = pc.match_substring(full, "\x00").to_numpy(zero_copy_only=False)
        units = pc.split_pattern(marked, "\x00")
        if odd.any():  # texts with the separator in them are cut apart here
            import re

            cut = re.compile("(?<=[^ ])(?= )").split
            rows = units.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                rows[i] = cut(" " + full[i].as_py())
            units = pa.array(rows, pa.list_(pa.string()))
        per = np.diff(units.offsets.to_numpy()).astype(np.int64)
        coded = units.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        raw = names.to_pylist()
        points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
        wl = np.fromiter(map(len, raw), np.int64, len(raw))
        ws = np.cumsum(wl) - wl
        if rate > 0:  # every occurrence by itself
            doc = mix64(ids[some].astype(np.uint64) + mix64(np.array([seed], np.uint64)))
            place = np.arange(len(code)) - np.repeat(np.cumsum(per) - per, per)
            with np.errstate(over="ignore"):
                key = mix64(np.repeat(doc, per) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            own, which = code, np.arange(len(code))
        else:
            own, which = np.arange(len(raw)), code
            key = np.zeros(len(raw), np.uint64)
        made = []
        for a in range(0, len(own), block):  # arrays of a size that stays in the processor's cache
            part, its_key = own[a : a + block], key[a : a + block]
            long_ = wl[part] > LONG
            short = part[~long_]
            got, per_unit = self.merge(points[spans(ws[short], wl[short])], wl[short], its_key[~long_], rate)
            if long_.any():
                got, per_unit = self._with_long(got, per_unit, [points[ws[u] : ws[u] + wl[u]] for u in part[long_]], its_key[long_], np.flatnonzero(long_), rate)
            made.append(self.to_ids(got, per_unit))
        sym, counts = (np.concatenate([x[k] for x in made]) for k in (0, 1)) if made else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        starts = np.cumsum(counts) - counts
        n = np.zeros(len(texts), np.int64)
        unit_n = counts[which]
        ends = np.concatenate([[0], np.cumsum(unit_n)])[np.cumsum(per)] if len(per) else np.zeros(0, np.int64)
        n[some] = np.diff(np.concatenate([[0], ends]))
        return sym[spans(starts[which], unit_n)], n

    def _with_long(self, sym: np.ndarray, counts: np.ndarray, units: list[np.ndarray], keys: np.ndarray, at: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a block's short units with those of its long ones at their places."""
        parts = np.split(sym, np.cumsum(counts)[:-1]) if len(counts) else []
        for k, unit, key in zip(at.tolist(), units, keys.tolist(), strict=True):
            parts.insert(k, self.merge_long(unit, key, rate))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts."""
        lens = self.piece_len[ids]
        raw = self.piece_bytes[spans(self.piece_start[ids], lens)]
        total = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        some = np.diff(total) > 0  # without the space put before
        keep = np.ones(len(raw), bool)
        keep[total[:-1][some]] = False
        return raw[keep], total - np.concatenate([[0], np.cumsum(some)])


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch of few documents and bytes (but one document at least)."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + DOCS]), BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


def _encode(batches: Iterator[pa.RecordBatch], path: str, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        for part in _slices(batch):
            keys = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n = m.encode(part.column("text"), keys, rate, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            names = [x for x in part.schema.names if x != "ids"]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), lists], [*names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, _texts(m, batch.column("ids"))], [*batch.schema.names, "decoded"])


def _texts(m: Model, lists: pa.ListArray) -> pa.StringArray:
    offs = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]] if len(lists) else np.zeros(0, np.int32)
    raw, at = m.decode(ids, np.diff(offs))
    return pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def _check(batches: Iterator[pa.RecordBatch], path: str, **how) -> Iterator[pa.RecordBatch]:
    """Both ways in one worker: what comes out of decoding is held against the text."""
    m = model(path)
    for batch in batches:
        for part in _encode(iter([batch]), path, **how):
            lists = part.column("ids")
            same = pc.equal(pc.fill_null(part.column("text"), ""), _texts(m, lists))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), same, lists], ["doc_id", "n_ids", "lossless", "ids"])


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id and text if not given) and ids array<int>; keep must hold doc_id and text."""
    rows = docs.select(*(keep or ["doc_id", "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(partial(_encode, path=model_path, rate=rate, seed=seed), f"{schema}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds `decoded` to rows with ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(partial(_decode, path=model_path), f"{schema}, decoded string")


def encode_checked(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17) -> DataFrame:
    """doc_id, n_ids, whether decoding gave the text again, and ids."""
    work = partial(_check, path=model_path, rate=rate, seed=seed)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_ids long, lossless boolean, ids array<int>")


def production_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"), production_model())


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids for every document, with the columns of documents but the text."""
    small_batches(spark)
    kept = [c for c in docs.columns if c != "ids"]
    return encode(docs, production_model(), keep=kept).drop("text")
