"""Media columns as FLAC: texts stored as 8-bit mono streams, and decoded block by block.

A payload's bytes become 8-bit samples (see ZERO) in frames of 1152 (the last one shorter). Each frame takes the
cheapest of a constant, verbatim samples, fixed predictors of order 0 to 2 and a quantised linear predictor, with Rice
residuals; headers carry CRC-8, frames CRC-16, the stream the MD5 of its samples and a seek point for each frame. Both
ways work on all frames of a batch in step: one numpy operation advances every frame by a residual or a sample.

The decoder reads what this format profile writes (8-bit mono, one Rice partition a subframe), and raises ValueError
for a bad checksum or anything else. Nulls: a null text is empty, its payload 192 spaces; null doc_ids are kept;
repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import slices, utf8, written

UNIT, BLOCK, RATE = 192, 1152, 8000
#: A sample is a byte less ZERO, modulo 256, so small letters lie near zero; before, a space and a backquote change
#: places, so that spaces lie beside the letters.
ZERO = 109
_SWAP = np.arange(256, dtype=np.uint8)
_SWAP[[0x20, 0x60]] = 0x60, 0x20
LPC_ORDER, PRECISION = 4, 9
#: Bytes decoded at once: few enough for caches, many enough frames to be in step.
PIECE = 400_000
#: Fixed values of the format: block size codes; 7 says that 16 bits with the size less one follow.
SIZE_CODES = {192: 1, 576: 2, 1152: 3}
#: Taps of the fixed predictors.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << bits) - 1)
    return c


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Of the stretches starts:starts + sizes, all in step."""
    table = _CRC8 if bits == 8 else _CRC16
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    crc = np.zeros(len(starts), np.int64)
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else []
    for i, n in enumerate(live):
        b = data[starts[:n] + i]
        crc[:n] = table[crc[:n] ^ b] if bits == 8 else (crc[:n] << 8 & 0xFFFF) ^ table[crc[:n] >> 8 ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(~limit << 1 & 0xFF) | n, *reversed(tail)])


def _linear(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised taps (frames, order) and shifts, by autocorrelation and Levinson's recursion on all frames."""
    f = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : n - k]) for k in range(order + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-6) + 1e-3
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= 1 - k * k
        err = np.maximum(err, 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64) - 1, 0, 15)
    q = np.clip(np.round(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    return q, shift


def _residual(x: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = taps.shape[1]
    n = x.shape[1]
    guess = np.zeros((len(x), n - order), np.int32)
    for k in range(order):
        guess += taps[:, k : k + 1] * x[:, order - 1 - k : n - 1 - k]
    return x[:, order:] - (guess >> shift[:, None].astype(np.int32))


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, parameter, bits) of each frame."""
    z = (residual << 1) ^ (residual >> 31)
    best, bits = np.zeros(len(z), np.int64), np.full(len(z), 1 << 60)
    for k in range(9):
        b = (z >> k).sum(axis=1, dtype=np.int64) + z.shape[1] * (k + 1)
        best, bits = np.where(b < bits, k, best), np.minimum(b, bits)
    return z, best, bits


class _Bits:
    """Bits of many frames; each frame writes at its own place."""

    def __init__(self, starts: np.ndarray, total: int):
        self.bits, self.at = np.zeros(total, np.uint8), starts.copy()

    def put(self, rows, value, width: int):
        value = np.broadcast_to(np.asarray(value, np.int64), rows.shape)
        for j in range(width):
            self.bits[self.at[rows] + j] = value >> (width - 1 - j) & 1
        self.at[rows] += width


def _encode_frames(x: np.ndarray, heads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one size (frames, samples) with their headers (CRC-8 to come) -> (bytes, size of each frame)."""
    frames, n = x.shape
    constant = (x == x[:, :1]).all(axis=1)
    choices = []  # (bits, order, taps, shift, zigzag, parameter)
    for order in (0, 1, 2):
        taps = np.tile(np.array(FIXED[order], np.int32), (frames, 1)).reshape(frames, order)
        z, k, bits = _rice(_residual(x, taps, np.zeros(frames, np.int64)))
        choices.append((bits + 8 * order + 10, z, k))
    q, shift = _linear(x, LPC_ORDER)
    z, k, bits = _rice(_residual(x, q, shift))
    choices.append((bits + (8 + PRECISION) * LPC_ORDER + 9 + 10, z, k))
    cost = np.stack([np.where(constant, 8, 1 << 60), np.full(frames, 8 * n), *(c[0] for c in choices)], axis=1)
    pick = cost.argmin(axis=1)
    head = np.array([len(h) for h in heads])
    sizes = head + 1 + 1 + -(-cost[np.arange(frames), pick] // 8) + 2
    starts = np.cumsum(sizes) - sizes
    out = _Bits((starts + head + 1) * 8, int(sizes.sum()) * 8)
    for p in np.unique(pick):
        rows = np.flatnonzero(pick == p)
        kind = (0, 1, 8, 9, 10, 32 + LPC_ORDER - 1)[p]
        out.put(rows, kind << 1, 8)
        if p == 0:
            out.put(rows, x[rows, 0] & 0xFF, 8)
        elif p == 1:
            for i in range(n):
                out.put(rows, x[rows, i] & 0xFF, 8)
        else:
            order = LPC_ORDER if p == 5 else p - 2
            for i in range(order):
                out.put(rows, x[rows, i] & 0xFF, 8)
            if p == 5:
                out.put(rows, PRECISION - 1, 4)
                out.put(rows, shift[rows], 5)
                for i in range(order):
                    out.put(rows, q[rows, i] & ((1 << PRECISION) - 1), PRECISION)
            _, z, k = choices[p - 2]
            z, k = z[rows], k[rows]
            out.put(rows, 0, 6)
            out.put(rows, k, 4)
            size = (z >> k[:, None]) + (k + 1)[:, None]
            end = out.at[rows][:, None] + np.cumsum(size, axis=1)
            out.bits[end - (k + 1)[:, None]] = 1
            for j in range(int(k.max(initial=0))):
                some = np.flatnonzero(k > j)
                out.bits[end[some] - 1 - j] = z[some] >> j & 1
    data = np.packbits(out.bits)
    for i, h in enumerate(heads):
        data[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    data[starts + head] = _crc(data, starts, head, 8)
    crc = _crc(data, starts, sizes - 2, 16)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 0xFF
    return data, sizes


def _samples(raw: bytes) -> np.ndarray:
    return (_SWAP[np.frombuffer(raw, np.uint8)] - np.uint8(ZERO)).view(np.int8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads; each a positive multiple of UNIT bytes."""
    cut = [(i, a, min(len(p), a + BLOCK)) for i, p in enumerate(payloads) for a in range(0, len(p), BLOCK)]
    by_size: dict[int, list[int]] = {}
    for j, (_, a, b) in enumerate(cut):
        by_size.setdefault(b - a, []).append(j)
    frames: list[bytes] = [b""] * len(cut)
    for n, js in by_size.items():
        code = SIZE_CODES.get(n, 7)
        heads = [bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _coded_number(cut[j][1] // BLOCK) + (struct.pack(">H", n - 1) if code == 7 else b"") for j in js]
        raw = b"".join(payloads[cut[j][0]][cut[j][1] : cut[j][2]] for j in js)
        data, sizes = _encode_frames(_samples(raw).astype(np.int32).reshape(len(js), n), heads)
        ends = np.cumsum(sizes)
        for j, a, b in zip(js, ends - sizes, ends, strict=True):
            frames[j] = data[a:b].tobytes()
    of: list[list[tuple[int, int, bytes]]] = [[] for _ in payloads]
    for (i, a, b), f in zip(cut, frames, strict=True):
        of[i].append((a, b - a, f))
    return [_stream(p, fs) for p, fs in zip(payloads, of, strict=True)]


def _stream(payload: bytes, frames: list[tuple[int, int, bytes]]) -> bytes:
    sizes = [len(f) for _, _, f in frames]
    md5 = hashlib.md5(_samples(payload).tobytes()).digest()
    fields = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + fields.to_bytes(8, "big") + md5
    points, at = [], 0
    for first, n, f in frames:
        points.append(struct.pack(">QQH", first, at, n))
        at += len(f)
    table = b"".join(points)
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(f for _, _, f in frames)


def seek_points(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]]]:
    """(samples, MD5, [(first sample, byte offset in the stream, samples)]) from the metadata."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, n = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            fields = int.from_bytes(body[10:18], "big")
            if fields >> 36 & 0xFF != 7:
                raise ValueError("not 8-bit mono")
            total, md5 = fields & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = list(struct.iter_unpack(">QQH", body))
        at += 4 + n
    return total, md5, [(a, at + b, n) for a, b, n in points]


def _get(data: np.ndarray, at: np.ndarray, width) -> np.ndarray:
    """Up to 16 bits at bit positions."""
    i = at >> 3
    word = data[i].astype(np.int64) << 16 | data[i + 1].astype(np.int64) << 8 | data[i + 2]
    return word >> (24 - (at & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)


def _signed(v: np.ndarray, width: int) -> np.ndarray:
    return v - ((v >> (width - 1) & 1) << width)


def _decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int, numbers: np.ndarray) -> np.ndarray:
    """Frames of n samples at byte offsets; data has spare bytes at its end."""
    if (_crc(data, starts, sizes, 16) != 0).any():
        raise ValueError("a frame's checksum is wrong")
    code = SIZE_CODES.get(n, 7)
    if (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any() or (data[starts + 2] != (code << 4 | 4)).any() or (data[starts + 3] != 2).any():
        raise ValueError("a frame's header is not of this profile")
    lead = data[starts + 4].astype(np.int64)
    extra = np.where(lead < 0x80, 0, np.select([lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5], 6))
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for k in range(1, 7):
        number = np.where(extra >= k, number << 6 | data[starts + 4 + np.minimum(k, extra)] & 0x3F, number)
    head = 5 + extra + 2 * (code == 7)
    if (number != numbers).any() or (_crc(data, starts, head + 1, 8) != 0).any():
        raise ValueError("a frame header's checksum or number is wrong")
    kind = data[starts + head + 1].astype(np.int64) >> 1
    at = (starts + head + 2) * 8
    out = np.empty((len(starts), n), np.int32)
    rice, found = [], []
    for p in np.unique(kind):
        rows = np.flatnonzero(kind == p)
        pos = at[rows]
        if p == 0:
            out[rows] = _signed(_get(data, pos, 8), 8)[:, None]
            continue
        if p == 1:
            out[rows] = data[(pos >> 3)[:, None] + np.arange(n)].astype(np.int8)
            continue
        if not (8 <= p <= 12 or p >= 32):
            raise ValueError("a subframe of another kind")
        order = int(p - 31 if p >= 32 else p - 8)
        for i in range(order):
            out[rows, i] = _signed(_get(data, pos, 8), 8)
            pos = pos + 8
        taps, shift = np.tile(np.array(FIXED.get(order, []), np.int64), (len(rows), 1)), np.zeros(len(rows), np.int64)
        if p >= 32:
            precision = _get(data, pos, 4) + 1
            shift = _get(data, pos + 4, 5)
            pos = pos + 9
            taps = np.empty((len(rows), order), np.int64)
            for i in range(order):
                v = _get(data, pos, precision)
                taps[:, i] = v - ((v >> (precision - 1) & 1) << precision)
                pos = pos + precision
        if (_get(data, pos, 6) != 0).any():
            raise ValueError("residuals in several partitions")
        rice.append((p, order, rows, taps, shift))
        found.append((pos + 10, _get(data, pos + 6, 4)))
    if not rice:
        return out
    z = _residuals(data, *(np.concatenate(x) for x in zip(*found, strict=True)), n)
    first = 0
    for p, order, rows, taps, shift in rice:
        part = z[first : first + len(rows), : n - order]
        first += len(rows)
        residual = (part >> 1) ^ -(part & 1)
        if p == 8:
            out[rows] = residual
        elif p == 9:
            out[rows, 1:] = residual
            out[rows] = np.cumsum(out[rows], axis=1)
        else:
            out[rows, order:] = _restored(out[rows, :order], residual, taps, shift)
    return out


def _residuals(data: np.ndarray, at: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
    """Zigzag Rice codes (frames, count) of all frames in step; those past a frame's own count mean nothing."""
    low = int(at.min()) >> 3
    part = data[low:]
    bits = np.unpackbits(part)
    last = np.int32(len(bits) - 1)
    following = np.where(bits, np.arange(len(bits), dtype=np.int32), last)  # the first one at or after each bit
    np.minimum.accumulate(following[::-1], out=following[::-1])
    p, step = (at - 8 * low).astype(np.int32), (k + 1).astype(np.int32)
    ends = np.empty((count + 1, len(at)), np.int32)
    ends[0] = p
    for i in range(1, count + 1):
        p = np.minimum(following[p] + step, last)
        ends[i] = p
    q = np.diff(ends, axis=0) - step
    wide = np.concatenate((part, np.zeros(2, np.uint8))).astype(np.int32)
    words = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    begin = ends[1:] - k.astype(np.int32)
    tail = words[begin >> 3] >> (24 - (begin & 7) - k.astype(np.int32)) & ((1 << k) - 1).astype(np.int32)
    return (q << k.astype(np.int32) | tail).T


def _restored(warm: np.ndarray, residual: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = warm.shape[1]
    x = np.empty((order + residual.shape[1], len(warm)), np.int32)
    x[:order] = warm.T
    back, res, shift = taps.T[::-1].astype(np.int32), residual.T.astype(np.int32), shift.astype(np.int32)
    for i in range(len(res)):
        x[order + i] = res[i] + ((back * x[i : i + order]).sum(axis=0, dtype=np.int32) >> shift)
    return x[order:].T


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks (first sample, bytes), checksums verified."""
    base, cut, heads = 0, [], []
    for i, m in enumerate(media):
        total, md5, points = seek_points(m)
        heads.append((total, md5))
        ends = [p[1] for p in points[1:]] + [len(m)]
        cut += [(i, a, n, base + at, end - at) for (a, at, n), end in zip(points, ends, strict=True)]
        base += len(m)
    data = np.frombuffer(b"".join(media) + bytes(8), np.uint8)
    blocks: list[bytes] = [b""] * len(cut)
    by_size: dict[int, list[int]] = {}
    for j, c in enumerate(cut):
        by_size.setdefault(c[2], []).append(j)
    for n, js in by_size.items():
        for i in range(0, len(js), max(1, PIECE // n)):
            some = js[i : i + max(1, PIECE // n)]
            first, last = cut[some[0]][3], cut[some[-1]][3] + cut[some[-1]][4]
            starts = np.array([cut[j][3] for j in some]) - first
            x = _decode_frames(data[first : last + 8], starts, np.array([cut[j][4] for j in some]), n, np.array([cut[j][1] // BLOCK for j in some]))
            for j, row in zip(some, _SWAP[(x + ZERO).astype(np.uint8)], strict=True):
                blocks[j] = row.tobytes()
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]
    for c, b in zip(cut, blocks, strict=True):
        out[c[0]].append((c[1], b))
    for (total, md5), found in zip(heads, out, strict=True):
        pcm = b"".join(b for _, b in found)
        if len(pcm) != total or hashlib.md5(_samples(pcm).tobytes()).digest() != md5:
            raise ValueError("the samples' checksum is wrong")
    return out


def payload(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table: doc_id, n_bytes, media (FLAC)."""

    def run(batches):
        for b in slices(batches, "text", 1_000_000):
            texts = utf8(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, pcm: one row a frame."""

    def run(batches):
        for b in slices(batches, "media", 1_000_000):
            rows = [(i, a, len(p), p) for i, blocks in zip(b.column(0).to_pylist(), decode(b.column(1).to_pylist()), strict=True) for a, p in blocks]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "first_sample", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, first_sample long, n_samples long, pcm binary")


def _feature(pcm: bytes) -> str:
    x = _samples(pcm).astype(np.int32)
    rms = float(np.sqrt(np.mean(x * x)))
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={rms:.4f};peak={int(np.abs(x).max())};zero_crossings={turns};mean={float(x.mean()):.4f}"


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media sizes and digests, and a feature string, all from the stored streams."""

    def run(batches):
        for b in slices(batches, "media", 1_000_000):
            stored = b.column(2).to_pylist()
            pcm = [b"".join(p for _, p in blocks) for blocks in decode(stored)]
            cols = [
                pa.array([len(p) for p in pcm], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in pcm]),
                pa.array([zlib.crc32(p[-16:]) for p in pcm], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([_feature(p) for p in pcm]),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
