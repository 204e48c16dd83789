"""Motion-JPEG in AVI: writing, RIFF index parsing, intra-frame decoding, shots and clips.

A payload byte is one flat 8x8 block of a greyscale baseline JPEG frame: the quantiser of the DC coefficient is 8, so the
block's level is exactly the byte and every decoder gives it back.  A frame is 64 blocks wide, each row of blocks is a
restart interval, and frames are stored without loss.

The decoder takes baseline frames of any writer: tables, sampling and restart interval come from the frame's own segments.  The
restart intervals of all frames with the same segments are read in step, a Huffman code of each at a time, by numpy.  Films are
written and read some frames at a time, so the memory for a long text is a small multiple of it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, documents, tidy, utf8

WIDE, HIGH = 64, 8  # blocks of a frame
PER_FRAME = WIDE * HIGH
#: Frames that are written or read together.
FRAMES = 512
FPS = 25
#: The DC code: category s (0 to 8, bits of the difference) has the code s of 4 bits.  The AC code: end of block is "0".
_CATEGORIES = 9
_DQT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)
_SOF = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])
_DHT = b"\xff\xc4" + struct.pack(">HB", 19 + _CATEGORIES, 0x00) + bytes([0, 0, 0, _CATEGORIES] + [0] * 12) + bytes(range(_CATEGORIES)) + b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1] + [0] * 15) + b"\x00"
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, WIDE)
_SOS = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
_HEAD = b"\xff\xd8" + _DQT + _SOF + _DHT + _DRI + _SOS
_BITLEN = np.array([int(abs(d)).bit_length() for d in range(-256, 256)], dtype=np.int64)


def _scan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded rows of 64 samples: all bytes with stuffing and restart markers after each row, and the row ends."""
    rows = samples.reshape(-1, WIDE).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0)
    size = _BITLEN[diff + 256]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 5  # code, bits, end of block
    value = ((size << size) | bits) << 1
    begin = np.cumsum(length, axis=1) - length
    nbytes = (begin[:, -1] + length[:, -1] + 7) // 8
    base = np.cumsum(nbytes) - nbytes
    total = int(nbytes.sum())
    at = (begin + (base * 8)[:, None]).ravel()
    word = value.ravel() << (24 - (at & 7) - length.ravel())  # 13 bits and a shift of 7 fit 20 of these 24
    word = np.bincount(at >> 3, weights=word, minlength=total).astype(np.int64)  # codes don't overlap, so a sum is a union
    out = np.zeros(total + 3, dtype=np.int64)
    for k in range(3):
        out[k : total + k] |= (word >> (16 - 8 * k)) & 255
    pad = nbytes * 8 - (begin[:, -1] + length[:, -1])
    out[base + nbytes - 1] |= (1 << pad) - 1
    raw = out[:total].astype(np.uint8)
    ff = raw == 255
    extra = np.cumsum(ff) - ff
    ends = np.cumsum(nbytes)
    row_of = np.repeat(np.arange(len(rows)), nbytes)
    final = np.zeros(total + int(ff.sum()) + 2 * len(rows), dtype=np.uint8)
    final[np.arange(total) + extra + 2 * row_of] = raw
    stops = ends + np.cumsum(ff)[ends - 1] + 2 * np.arange(len(rows))
    final[stops] = 255
    final[stops + 1] = 0xD0 + np.arange(len(rows)) % HIGH % 8
    return final, stops + 2


def encode_films(payloads: list[bytes]) -> list[bytes]:
    """An AVI of one MJPG stream for each payload.  The last frame is filled up with zeros; the payload's length is in an
    INFO chunk."""
    films: list[list[bytes]] = [[] for _ in payloads]
    parts = ((film, p[a : a + PER_FRAME].ljust(PER_FRAME, b"\0")) for film, p in zip(films, payloads, strict=True) for a in range(0, max(1, len(p)), PER_FRAME))
    while some := list(itertools.islice(parts, FRAMES)):
        data, ends = _scan(np.frombuffer(b"".join(x for _, x in some), np.uint8))
        raw, start = data.tobytes(), 0
        for (film, _), end in zip(some, ends[HIGH - 1 :: HIGH].tolist(), strict=True):
            film.append(_HEAD + raw[start : end - 2] + b"\xff\xd9")
            start = end
    return [_avi(film, len(p)) for film, p in zip(films, payloads, strict=True)]


def _avi(frames: list[bytes], length: int) -> bytes:
    count = len(frames)
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1))
        at += len(chunks[-1])
    most = max(map(len, frames))
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, count, 0, 1, most, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, most, 0xFFFFFFFF, 0, 0, 0, WIDE * 8, HIGH * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDE * 8, HIGH * 8, 1, 24, b"MJPG", WIDE * HIGH * 192, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\0" % length))
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index)))


class Avi:
    """A parsed AVI: frames as (offset, size) by the idx1 index (or by walking movi where there is none), rate, payload."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.micros, self.payload, self.frames = data, 1_000_000 // FPS, None, []
        movi = index = None
        for tag, at, size in self._walk(12, len(data)):
            kind = data[at : at + 4] if tag == b"LIST" else tag
            if kind == b"hdrl":
                for t, a, _ in self._walk(at + 4, at + size):
                    if t == b"avih":
                        self.micros = struct.unpack_from("<I", data, a)[0] or self.micros
            elif kind == b"INFO":
                for t, a, n in self._walk(at + 4, at + size):
                    if t == b"ICMT" and data[a : a + 8] == b"payload=":
                        self.payload = int(data[a + 8 : a + n].rstrip(b"\0"))
            elif kind == b"movi":
                movi = (at, size)
            elif kind == b"idx1":
                index = (at, size)
        if movi is None:
            raise ValueError("no movi list")
        if index:
            entries = [struct.unpack_from("<4sIII", data, index[0] + i) for i in range(0, index[1] - 15, 16)]
            base = movi[0] if not entries or data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0
            self.frames = [(base + o + 8, n) for tag, _, o, n in entries if tag[2:] in (b"dc", b"db")]
        else:
            self.frames = [(a, n) for t, a, n in self._walk(movi[0] + 4, movi[0] + movi[1]) if t[2:] in (b"dc", b"db")]

    def _walk(self, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            tag, size = self.data[at : at + 4], struct.unpack_from("<I", self.data, at + 4)[0]
            yield tag, at + 8, min(size, end - at - 8)
            at += 8 + size + (size & 1)


class Header:
    """What a baseline frame's segments say: size, components (id, horizontal and vertical sampling, quantiser), Huffman tables,
    restart interval, and the components of the scan."""

    def __init__(self, segments: bytes) -> None:
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], np.ndarray] = {}  # (class, id): length and value by the next 16 bits
        self.interval, self.components, at = 0, [], 0
        while at + 4 <= len(segments):
            code, size = segments[at + 1], struct.unpack_from(">H", segments, at + 2)[0]
            body = segments[at + 4 : at + 2 + size]
            if code == 0xDB:
                self._quantisers(body)
            elif code == 0xC4:
                self._codes(body)
            elif code == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif code == 0xC0 or code == 0xC1 and body[0] == 8:
                self.high, self.wide = struct.unpack_from(">HH", body, 1)
                self.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
                raise ValueError("only baseline frames are decoded")
            elif code == 0xDA:
                self.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            at += 2 + size
        if not self.components or [c[0] for c in self.components] != [c[0] for c in self.scan]:
            raise ValueError("one scan with all components expected")
        if len(self.components) == 1:  # blocks of a single component come row by row, whatever its sampling
            self.components = [(self.components[0][0], 1, 1, self.components[0][3])]
        self.across = -(-self.wide // (8 * max(c[1] for c in self.components)))  # units of a row
        self.down = -(-self.high // (8 * max(c[2] for c in self.components)))

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide = body[at] >> 4
            self.quantisers[body[at] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
            at += 1 + 64 * (1 + wide)

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            table = np.zeros((1 << 16, 2), dtype=np.int16)
            code, value = 0, at + 17
            for length, count in enumerate(counts, 1):
                for _ in range(count):
                    first = code << (16 - length)
                    table[first : first + (1 << (16 - length))] = length, body[value]
                    code, value = code + 1, value + 1
                code <<= 1
            self.codes[body[at] >> 4, body[at] & 15] = table
            at = value


@functools.lru_cache(maxsize=64)
def _header(segments: bytes) -> Header:
    return Header(segments)


def _segments(frame: bytes) -> int:
    """Where a frame's scan begins."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        if frame[at] != 0xFF:
            raise ValueError("marker expected")
        code = frame[at + 1]
        if code == 0xFF:
            at += 1
            continue
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if code == 0xDA:
            return at


def _lanes(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of scans without stuffing and markers, and where each restart interval begins among them."""
    buf = np.frombuffer(b"".join(x for s in scans for x in (s, b"\xff\xd0")), np.uint8)
    ff = buf[:-1] == 255
    stuffed = np.flatnonzero(ff & (buf[1:] == 0)) + 1
    marks = np.flatnonzero(ff & (buf[1:] >= 0xD0) & (buf[1:] <= 0xD7))
    drop = np.zeros(len(buf), dtype=bool)
    drop[stuffed] = drop[marks] = drop[marks + 1] = True
    begin = np.concatenate(([0], np.cumsum(~drop)[marks][:-1]))
    return np.concatenate([buf[~drop], np.full(8, 255, np.uint8)]), begin


def coefficients(h: Header, scans: list[bytes]) -> np.ndarray:
    """(frames, units, blocks of a unit, 64) quantised coefficients in zigzag order.  All restart intervals are read in step."""
    units = h.across * h.down
    each = min(h.interval or units, units)  # units of an interval
    raw, begin = _lanes(scans)
    per_frame = -(-units // each)
    if len(begin) != per_frame * len(scans):
        raise ValueError("restart markers are missing")
    word = raw.astype(np.int64)
    word = (word[:-3] << 24) | (word[1:-2] << 16) | (word[2:-1] << 8) | word[3:]
    plan = [k for k, c in enumerate(h.components) for _ in range(c[1] * c[2])]  # components of a unit's blocks
    names = list(dict.fromkeys([(0, d) for _, d, _ in h.scan] + [(1, a) for _, _, a in h.scan]))
    tables = np.concatenate([h.codes[n] for n in names]).astype(np.int64)
    dc, ac = (np.array([names.index((cls, h.scan[k][1 + cls])) for k in plan]) << 16 for cls in (0, 1))
    part = np.arange(len(begin)) % per_frame
    todo = np.minimum(each, units - part * each) * len(plan)  # blocks of each lane
    out = np.zeros((len(begin) * each * len(plan), 64), dtype=np.int16)
    base = np.arange(len(begin)) * (each * len(plan))
    lane = np.flatnonzero(todo > 0)
    at, block, k = begin[lane] * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    level = np.zeros((len(begin), len(h.components)), dtype=np.int64)
    of = np.array(plan)
    while len(lane):
        kind = block % len(plan)
        first = k == 0
        w = (word[np.minimum(at >> 3, len(word) - 1)] << (at & 7)) & 0xFFFFFFFF  # 25 bits at least
        entry = tables[(w >> 16) + np.where(first, dc[kind], ac[kind])]
        length, value = entry[:, 0], entry[:, 1]
        if (length == 0).any() or (at >> 3 >= len(raw)).any():
            raise ValueError("a code that no table has")
        size = np.where(first, value, value & 15)
        at = at + length
        w = (word[np.minimum(at >> 3, len(word) - 1)] << (at & 7)) & 0xFFFFFFFF
        bits = w >> (32 - size)
        bits = np.where(size > 0, np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1), 0)
        at = at + size
        run = np.where(first, 0, value >> 4)
        end = ~first & (size == 0) & (run < 15)  # end of block; else 16 zeros
        place = k + run
        put = first | (size > 0)
        comp = of[kind]
        level[lane[first], comp[first]] += bits[first]
        bits = np.where(first, level[lane, comp], bits)
        if (place[put] > 63).any():
            raise ValueError("too many coefficients in a block")
        out[(base[lane] + block)[put], place[put]] = bits[put]
        k = np.where(end, 64, place + 1)
        done = k >= 64
        block, k = block + done, np.where(done, 0, k)
        if done.any() and (over := block >= todo[lane]).any():
            go = ~over
            lane, at, block, k = lane[go], at[go], block[go], k[go]
    out = out.reshape(len(scans), per_frame * each, len(plan), 64)
    return out[:, :units]


def _zigzag() -> np.ndarray:
    """Place by row of each coefficient of the zigzag: diagonals in turn, upwards and downwards."""
    return np.array([r * 8 + d - r for d in range(15) for r in (range(8) if d % 2 else range(7, -1, -1)) if 0 <= d - r < 8])


_ZIGZAG = _zigzag()
#: Rows of the inverse cosine transform: sample x from frequency u.
_COS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _luma(h: Header, found: np.ndarray) -> np.ndarray:
    """(frames, high, wide) samples of the first component, in whole units."""
    _, sx, sy, q = h.components[0]
    quantiser = h.quantisers[q]
    own = found[:, :, : sx * sy]
    if own.shape[0] and not own[..., 1:].any():  # flat blocks
        flat = np.clip(np.floor(own[..., 0] * int(quantiser[0]) / 8 + 128.5), 0, 255).astype(np.uint8)
        cells = np.broadcast_to(flat[..., None, None], (*flat.shape, 8, 8))
    else:
        values = np.zeros(own.shape, dtype=np.float64)
        values[..., _ZIGZAG] = own * quantiser
        samples = _COS @ values.reshape(*own.shape[:-1], 8, 8) @ _COS.T
        cells = np.clip(np.floor(samples + 128.5), 0, 255).astype(np.uint8)
    n = len(found)
    cells = cells.reshape(n, h.down, h.across, sy, sx, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    return cells.reshape(n, h.down * sy * 8, h.across * sx * 8)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Each frame's luma samples, (high, wide) as uint8.  Frames with the same segments are read together, some at a time; where
    luma isn't the largest component, its own sampling is given."""
    out: list[np.ndarray | None] = [None] * len(frames)
    alike: dict[bytes, list[tuple[int, int]]] = {}
    for i, f in enumerate(frames):
        at = _segments(f)
        alike.setdefault(f[2:at], []).append((i, at))
    for segments, members in alike.items():
        h = _header(segments)
        most = max(h.components, key=lambda c: c[1] * c[2])
        high, wide = (-(-h.high * h.components[0][2] // most[2]), -(-h.wide * h.components[0][1] // most[1]))
        step = max(1, FRAMES * PER_FRAME // (h.across * h.down * sum(c[1] * c[2] for c in h.components)))
        for a in range(0, len(members), step):
            some = members[a : a + step]
            planes = _luma(h, coefficients(h, [frames[i][at : frames[i].rindex(b"\xff\xd9")] for i, at in some]))
            for (i, _), plane in zip(some, planes, strict=True):
                out[i] = plane[:high, :wide]
    return out


def block_levels(frames: list[bytes]) -> np.ndarray:
    """(frames, high, wide) levels of the 8x8 blocks, as this writer makes them: the sample in each block's corner."""
    parts = [np.stack([x[::8, ::8] for x in decode_frames(frames[a : a + FRAMES])]) for a in range(0, len(frames), FRAMES)]
    return np.concatenate(parts)


def shots(levels: np.ndarray | list[np.ndarray], window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[first, last) frames of each shot.  A cut is where the difference of 16-bin histograms (half the L1 distance, 0 to
    1) passes both `least` and `factor` times the mean difference over the last `window` frames of the same shot."""
    n = len(levels)
    hist = np.stack([np.bincount(f.ravel() >> 4, minlength=16) / f.size for f in levels])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, recent = [0], []
    for i, d in enumerate(diff.tolist(), 1):
        if d > least and d > factor * (sum(recent) / len(recent) if recent else 0.0):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[-window + 1 :], d]
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def _films(texts: list[bytes]) -> Iterator[tuple[bytes, bytes, Avi, np.ndarray]]:
    """Each text with its film, the film as parsed, and the levels decoded from it.  Frames of all texts decode together."""
    films = encode_films([padded(t) for t in texts])
    parsed = [Avi(f) for f in films]
    levels = block_levels([f[a : a + n] for f, avi in zip(films, parsed, strict=True) for a, n in avi.frames])
    at = 0
    for text, film, avi in zip(texts, films, parsed, strict=True):
        yield text, film, avi, levels[at : at + len(avi.frames)]
        at += len(avi.frames)


def film_clips(data: bytes) -> list[tuple[float, float, int, int]]:
    """(start, end in seconds, first and last frame) of the shots of any motion-JPEG AVI."""
    avi = Avi(data)
    planes = decode_frames([data[a : a + n] for a, n in avi.frames])
    s = avi.micros / 1e6
    return [(a * s, b * s, a, b) for a, b in shots(planes)] if planes else []


def clips(docs: DataFrame) -> DataFrame:
    """Timed clip rows of each document's film: doc_id, clip, first_frame, last_frame (exclusive), start_s, end_s, mean_level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 18):
                rows = []
                for doc, (_, _, avi, levels) in zip(part.column("doc_id").to_pylist(), _films(utf8(part.column("text"))), strict=True):
                    s = avi.micros / 1e6
                    rows += [(doc, i, a, b, a * s, b * s, float(levels[a:b].mean())) for i, (a, b) in enumerate(shots(levels))]
                names = ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_level"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()] * 3, strict=True)], names)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, clip long, first_frame long, last_frame long, start_s double, end_s double, mean_level double")


def films(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Payload figures are of the bytes decoded from the film.  feature: frames, clips and the CRC-32 of the clips' bounds
    and histograms.  Equal texts give equal films.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 18):
                rows = []
                for text, media, avi, levels in _films(utf8(part.column("text"))):
                    back = levels.tobytes()[: avi.payload]
                    cut = shots(levels)
                    digest = zlib.crc32(np.concatenate([np.concatenate([[a, b], np.bincount(levels[a:b].ravel() >> 4, minlength=16)]) for a, b in cut]).astype("<i8").tobytes())
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(levels)};clips={len(cut)};crc={digest:08x}"))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
