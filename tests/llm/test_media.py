"""The decoder against streams written here bit by bit, with every feature of the format."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import media
from tidemark.llm.media import CODE_LENGTH_ORDER, decode, encode, predict

from .conftest import by_id


class Writer:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, lengths: dict[int, int], size: int, simple: bool = True) -> dict[int, str]:
        """Writes a prefix code; returns the bits of each symbol."""
        used = sorted(lengths)
        if simple and len(used) <= 2 and max(used) < 256:
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for s in used:
                self.put(s, 8)
            return {used[0]: ""} if len(used) == 1 else {used[0]: "0", used[1]: "1"}
        seq, at, flat = [], 0, [lengths.get(i, 0) for i in range(size)]
        while at < size:  # runs of zeros by 17 and 18, runs of others by 16
            run = 1
            while at + run < size and flat[at + run] == flat[at]:
                run += 1
            if not flat[at] and run >= 11:
                n = min(run, 138)
                seq.append((18, n - 11, 7))
            elif not flat[at] and run >= 3:
                n = min(run, 10)
                seq.append((17, n - 3, 3))
            elif run >= 4:
                seq.append((flat[at], 0, 0))
                n = min(run - 1, 6)
                seq.append((16, n - 3, 2))
                n += 1
            else:
                n = 1
                seq.append((flat[at], 0, 0))
            at += n
        self.put(0, 1)
        self.put(15, 4)
        inner = {s: 5 for s in range(19)}  # 19 symbols: 13 of 4 bits and 6 of 5 bits make a complete code
        inner |= dict.fromkeys(range(13), 4)
        for s in CODE_LENGTH_ORDER:
            self.put(inner[s], 3)
        self.put(0, 1)
        words = canonical(inner)
        for s, extra, n in seq:
            self.word(words[s])
            self.put(extra, n)
        return canonical(lengths)

    def word(self, bits: str) -> None:
        self.bits += map(int, bits)

    def file(self) -> bytes:
        body = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last = f"{code:0{n}b}" if n else "", n
        code += 1
    return out


def lengths_for(symbols) -> dict[int, int]:
    """A complete code with unequal lengths."""
    s = sorted(set(symbols))
    if len(s) == 1:
        return {s[0]: 1}
    return {x: min(i + 1, len(s) - 1) for i, x in enumerate(s)} if len(s) <= 12 else balanced(s)


def balanced(s) -> dict[int, int]:
    n = (len(s) - 1).bit_length()
    short = (1 << n) - len(s)
    return {x: n - (i < short) for i, x in enumerate(s)}


def write_image(w: Writer, pixels: np.ndarray, main: bool, cache: int = 0, ops=None, meta=None) -> None:
    """ops: ('lit', argb), ('ref', length, distance code), ('cache', index)."""
    ops = ops or [("lit", int(p)) for p in pixels.ravel()]
    w.put(1, 1) if cache else w.put(0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(1 if meta else 0, 1)
        if meta:
            w.put(meta[0] - 2, 3)
            write_image(w, meta[1].astype(np.uint32) << 8, False)
    groups = int(meta[1].max()) + 1 if meta else 1
    owner = meta[2] if meta else (lambda k: 0)
    used = [[[0], [0], [0], [0], [0]] for _ in range(groups)]
    prefix = lambda v: (v - 1, 0, 0) if v <= 4 else next((s, v - 1 - ((2 + (s & 1)) << (s - 2 >> 1)), s - 2 >> 1) for s in range(4, 40) if ((2 + (s & 1)) << (s - 2 >> 1)) <= v - 1 < ((2 + (s & 1)) << (s - 2 >> 1)) + (1 << (s - 2 >> 1)))
    at = 0
    places = []
    for op in ops:
        g = used[owner(at)]
        places.append(owner(at))
        if op[0] == "lit":
            for k, shift in enumerate((8, 16, 0, 24)):
                g[k].append(op[1] >> shift & 255)
            at += 1
        elif op[0] == "ref":
            g[0].append(256 + prefix(op[1])[0])
            g[4].append(prefix(op[2])[0])
            at += op[1]
        else:
            g[0].append(280 + op[1])
            at += 1
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    codes = [[w.code(lengths_for(s), n) for s, n in zip(g, sizes, strict=True)] for g in used]
    for op, own in zip(ops, places, strict=True):
        c = codes[own]
        if op[0] == "lit":
            for k, shift in enumerate((8, 16, 0, 24)):
                w.word(c[k][op[1] >> shift & 255])
        elif op[0] == "ref":
            s, extra, n = prefix(op[1])
            w.word(c[0][256 + s])
            w.put(extra, n)
            s, extra, n = prefix(op[2])
            w.word(c[4][s])
            w.put(extra, n)
        else:
            w.word(c[0][280 + op[1]])


def header(width: int, height: int) -> Writer:
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


RNG = np.random.default_rng(5)


def random_pixels(h, w, colours=40):
    return RNG.integers(0, 1 << 32, colours, dtype=np.uint64)[RNG.integers(0, colours, (h, w))].astype(np.uint32)


@pytest.mark.parametrize("colours", [1, 2, 3, 40])
def test_literals(colours):
    pixels = random_pixels(7, 9, colours)
    w = header(9, 7)
    w.put(0, 1)
    write_image(w, pixels, True)
    assert (decode(w.file()) == pixels).all()


def test_back_references_and_colour_cache():
    width, cache = 8, 3
    ops = [("lit", 0xFF102030), ("lit", 0x80AABBCC), ("lit", 0x01020304), ("ref", 5, 2), ("ref", 6, 1), ("ref", 9, 120 + 3), ("lit", 7), ("ref", 8, 4)]
    out = []
    for op in ops:
        if op[0] == "lit":
            out.append(op[1])
        else:
            x, y = media.SHORT_DISTANCES[op[2] - 1] if op[2] <= 120 else (op[2] - 120, 0)
            d = max(1, x + y * width)
            for _ in range(op[1]):
                out.append(out[-d])
    table = [0] * (1 << cache)
    for p in out:
        table[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)] = p
    for k in range(32):  # every slot of the cache, changed by what it gives
        ops.append(("cache", k % 8))
        out.append(table[k % 8])
        p = out[-1]
        table[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)] = p
    out = np.array(out, np.uint32)
    assert len(out) % width == 0
    w = header(width, len(out) // width)
    w.put(0, 1)
    write_image(w, out, True, cache, ops)
    assert (decode(w.file()).ravel() == out).all()


def test_groups_of_codes():
    pixels = random_pixels(9, 10)
    tiles = RNG.integers(0, 3, (3, 3)).astype(np.uint32)
    tiles[0, :] = [0, 1, 2]
    w = header(10, 9)
    w.put(0, 1)
    write_image(w, pixels, True, meta=(2, tiles, lambda k: int(tiles[k // 10 // 4, k % 10 // 4])))
    assert (decode(w.file()) == pixels).all()


def channels(p):
    return [int(p) >> s & 255 for s in (24, 16, 8, 0)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    h, wd = 6, 7
    pixels = random_pixels(h, wd)
    flat, rest = pixels.ravel(), []
    for k, p in enumerate(flat):
        y, x = divmod(k, wd)
        at = lambda d: channels(flat[k - d])  # noqa: B023, E731
        guess = [255, 0, 0, 0] if not k else at(1) if not y else at(wd) if not x else predict(mode, at(1), at(wd), at(wd + 1), at(wd - 1))
        rest.append(sum((a - b & 255) << s for a, b, s in zip(channels(p), guess, (24, 16, 8, 0), strict=True)))
    w = header(wd, h)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    write_image(w, np.full((2, 2), mode << 8, np.uint32), False)
    w.put(0, 1)
    write_image(w, np.array(rest, np.uint32), True)
    assert (decode(w.file()) == pixels).all()


# Fixed values, worked out by hand from the format's description: mode, left, top, top left, top right, prediction.
PREDICTED = [(5, 10, 20, 30, 40, 22), (6, 10, 20, 31, 40, 20), (7, 11, 20, 0, 0, 15), (8, 0, 21, 30, 0, 25), (9, 0, 21, 0, 40, 30), (10, 10, 20, 30, 41, 25),
             (11, 10, 200, 190, 0, 10), (11, 200, 10, 190, 0, 10), (12, 200, 100, 30, 0, 255), (12, 10, 20, 90, 0, 0), (13, 10, 20, 5, 0, 20), (13, 10, 20, 40, 0, 3)]


@pytest.mark.parametrize("case", PREDICTED)
def test_predictions_by_hand(case):
    mode, left, top, corner, beyond, want = case
    assert predict(mode, *([x] * 4 for x in (left, top, corner, beyond))) == [want] * 4


def test_cross_colour_and_green():
    h, wd = 5, 6
    pixels = random_pixels(h, wd)
    signed = lambda v: v - 256 if v > 127 else v
    g2r, g2b, r2b = 0x35, 0xE0, 0x9C
    rest = []
    for p in pixels.ravel():
        a, r, g, b = channels(p)
        b2 = b - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5) & 255
        r2 = r - (signed(g2r) * signed(g) >> 5) & 255
        rest.append(a << 24 | (r2 - g & 255) << 16 | g << 8 | (b2 - g & 255))
    w = header(wd, h)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)
    write_image(w, np.array([[0xFF000000 | r2b << 16 | g2b << 8 | g2r]], np.uint32), False)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    write_image(w, np.array(rest, np.uint32), True)
    assert (decode(w.file()) == pixels).all()


def watched(monkeypatch, payload):
    """Writes and reads a payload; says what the decoder went through."""
    seen = Counter()
    resolve, predictor, palette, symbols = media._resolve, media.undo_predictor, media.undo_palette, media._symbols

    def on_symbols(bits, codes, total):
        got = symbols(bits, codes, total)
        seen["prefix codes"] += sum(c.width > 0 for c in codes)
        seen["uneven codes"] += sum(len(set((c.table & 15).tolist())) > 1 for c in codes)
        seen["literals"] += int((got[0] < 256).sum())
        seen["references"] += int(((got[0] >= 256) & (got[0] < 280)).sum())
        seen["cached"] += int((got[0] >= 280).sum())
        return got

    monkeypatch.setattr(media, "_symbols", on_symbols)
    monkeypatch.setattr(media, "_resolve", lambda *a: (seen.update(["images"]), resolve(*a))[1])
    monkeypatch.setattr(media, "undo_predictor", lambda *a: (seen.update(["predictor"]), predictor(*a))[1])
    monkeypatch.setattr(media, "undo_palette", lambda *a: (seen.update(["palette"]), palette(*a))[1])
    stored = encode(payload)
    got = (media.decode_all(stored) >> 8 & 255).astype(np.uint8).ravel()
    assert (got == payload).all()
    return seen, stored


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 16, 17, 64, 65, 200, 256])
@pytest.mark.parametrize("rows", [1, 2, 9, 700])
def test_writer_round_trips(monkeypatch, k, rows):
    payload = (RNG.integers(0, k, 64 * rows) * (256 // k)).astype(np.uint8)
    seen, stored = watched(monkeypatch, payload)
    pixels = decode(stored)
    assert pixels.shape == (rows, 64) and (pixels >> 24 == 255).all() and not (pixels & 0xFF00FF).any()
    assert (seen["palette"] > 0) == (k <= 16)


def test_writer_takes_a_predictor_for_slopes(monkeypatch):
    walk = (np.cumsum(RNG.integers(-2, 3, 64 * 200)) % 256).astype(np.uint8)
    seen, stored = watched(monkeypatch, walk)
    assert seen["predictor"] == 1 and seen["prefix codes"] and len(stored) < 0.5 * len(walk)
    columns = (np.cumsum(RNG.integers(-2, 3, (200, 64)), axis=0) % 256).astype(np.uint8).ravel()
    seen, stored = watched(monkeypatch, columns)
    assert seen["predictor"] == 1 and len(stored) < 0.5 * len(columns)


def test_writer_takes_a_cache_for_values_that_stay(monkeypatch):
    """A few slots of which each one's value changes now and then."""
    slots, out = {}, []
    slot_of = lambda v: (media.HASH * (0xFF000000 | v << 8) & 0xFFFFFFFF) >> 30
    by_slot = [[v for v in range(256) if slot_of(v) == s] for s in range(4)]
    for _ in range(64 * 150):
        s = int(RNG.integers(0, 4))
        if s not in slots or RNG.random() < 0.1:
            slots[s] = int(RNG.choice(by_slot[s]))
        out.append(slots[s])
    seen, stored = watched(monkeypatch, np.array(out, np.uint8))
    assert seen["cached"] > 1000 and len(stored) < 0.6 * len(out)


def test_writer_refers_back(monkeypatch):
    words = ["".join(map(chr, RNG.integers(97, 123, 7))) for _ in range(300)]
    raw = " ".join(RNG.choice(words, 3000)).encode()
    payload = np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8)
    seen, stored = watched(monkeypatch, payload)
    assert seen["references"] > 1000 and seen["uneven codes"] >= 2 and len(stored) < 0.5 * len(payload)
    run = np.full(64 * 500, 7, np.uint8)
    run[:3000] = RNG.integers(0, 256, 3000)
    seen, stored = watched(monkeypatch, run)
    assert 5 < seen["references"] < 100 and len(stored) < 4000


def test_documents_go_through_codes_and_references(monkeypatch, docs_pd):
    """Every document's image is read through uneven prefix codes, and references give more than a third of the bytes."""
    texts = [t.encode() for t in docs_pd.text.fillna("") if len(t.encode()) > 500]
    total = Counter()
    size = 0
    for raw in texts:
        payload = np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8)
        with monkeypatch.context() as m:
            seen, stored = watched(m, payload)
        assert seen["images"] == 1 and seen["uneven codes"] >= 1 and seen["references"] > 0
        total.update(seen)
        total["bytes"] += len(payload)
        size += len(stored)
    assert total["literals"] < 0.65 * total["bytes"] and size < 0.55 * total["bytes"]


def test_long_payloads_are_several_files():
    payload = RNG.integers(0, 64, media.IMAGE + 64 * 5).astype(np.uint8)
    payload[1000:400_000] = payload[500_000:899_000]
    stored = encode(payload)
    assert stored.count(b"WEBPVP8L") == 2
    pixels = media.decode_all(stored)
    assert pixels.shape == (len(payload) // 64, 64) and (pixels >> 8 & 255 == payload.reshape(-1, 64)).all()


@pytest.mark.parametrize("n", [2, 3, 19, 200])
@pytest.mark.parametrize("limit", [7, 15])
def test_code_lengths_are_complete_and_limited(n, limit):
    if n > 1 << limit:
        return
    counts = [int(1.9**k) + 1 if k < 60 else k for k in range(n)]
    got = media.code_lengths(counts, limit)
    assert max(got) <= limit and sum(2.0**-x for x in got) == 1
    assert {s: f"{w:0{x}b}"[::-1] for s, (w, x) in enumerate(zip(media.code_words(np.array(got)).tolist(), got, strict=True))} == canonical(dict(enumerate(got)))


def plain_feature(payload: bytes) -> str:
    h, total = len(payload) // 64, sum(payload)
    bright = 0
    for band in range(8):
        for column in range(8):
            own = [payload[y * 64 + x] for y in range(band * h // 8, (band + 1) * h // 8) for x in range(8 * column, 8 * column + 8)]
            bright = bright << 1 | (sum(own) * h * 64 > total * len(own))
    return f"64x{h}/{total}/{len(set(payload))}/{bright:016x}"


def test_broken_streams_raise():
    good = encode(np.arange(64, dtype=np.uint8))
    for bad in (good[:40], b"RIFF" + good[5:], good[:21] + b"\xff" * 30):
        with pytest.raises((ValueError, IndexError)):
            decode(bad)


def test_query_rows(docs, odd_docs, no_docs):
    for frame in (docs, odd_docs):
        got = by_id(media.read(media.store(frame)))
        want = by_id(frame.select("doc_id", "text"))
        assert len(got) == len(want)
        text = dict(zip(want.doc_id, want.text, strict=True))
        for r in got[got.doc_id.notna()].itertuples():
            raw = (text[r.doc_id] or "").encode()
            full = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            stored = encode(np.frombuffer(full, np.uint8))
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(full))
    assert media.read(media.store(no_docs)).count() == 0


@pytest.mark.parametrize("size", [6, 7, 13, 14, 15, 29, 30, 31, 4095, 4096, 4097])
def test_references_go_on_as_far_as_they_can(size):
    rng = np.random.default_rng(size)
    own = rng.integers(1, 200, size).astype(np.uint8)
    at, length, back = media.references(np.concatenate([own, [250], own, [251]]).astype(np.uint8))
    assert (at[0], length[0], back[0]) == (size + 1, min(size, 4096), size + 1)


def test_features_by_words_equal_sums_of_cells():
    rng = np.random.default_rng(4)
    for h in (1, 2, 3, 5, 7, 8, 9, 41, 300, 1500):
        for samples in (rng.integers(0, 256, (h, 64), np.uint8), np.full((h, 64), 255, np.uint8), np.zeros((h, 64), np.uint8)):
            ys, total = [k * h // 8 for k in range(9)], int(samples.sum(dtype=np.int64))
            bright = ""
            for a, b in zip(ys[:-1], ys[1:], strict=True):
                for x in range(0, 64, 8):
                    bright += str(int(int(samples[a:b, x : x + 8].sum(dtype=np.int64)) * h * 64 > total * (b - a) * 8))
            assert media.features(samples) == f"64x{h}/{total}/{len(np.unique(samples))}/{int(bright, 2):016x}"


def test_features_take_few_steps():
    """Eight bands and sixty-four cells were summed by themselves before."""
    samples = np.arange(64 * 40, dtype=np.int64).astype(np.uint8).reshape(40, 64)

    class Counted(np.ndarray):
        calls = 0

        def sum(self, *args, **kwargs):
            Counted.calls += 1
            return super().sum(*args, **kwargs)

    assert media.features(samples.view(Counted)) == media.features(samples)
    assert Counted.calls <= 1


def test_prefix_symbols_by_table():
    values = np.array([1, 2, 4, 5, 6, 4096, (1 << 14) - 1, 1 << 14, (1 << 14) + 1, 1 << 20])
    for some in (values, values[:7], values[:0]):
        for symbol, extra, n, value in zip(*media._symbol_of(some), some, strict=True):
            assert media.BASE[symbol] + extra == value and media.EXTRA[symbol] == n and extra < 1 << n
