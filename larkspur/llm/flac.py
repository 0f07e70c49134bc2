"""FLAC media columns: encode, verify and decode to PCM blocks, many frames at a time in numpy.

Reading: a stream's frames are found by its seek table, or where that leaves gaps by their sync codes;
every frame's header CRC-8 and CRC-16 are verified, Rice residuals (any partition order, both
parameter widths, escapes) are decoded for all frames of a batch side by side, and fixed or linear
predictors are run over the columns. The sum of all samples is compared with STREAMINFO's MD5. PCM is
written as blocks with their sample offsets, so a reader can start at any of them.

Writing: frames of 576 samples; for each the constant, verbatim, fixed (orders 0 to 4) or linear
(order 4, 8-bit coefficients) subframe is chosen, with one Rice partition, and the seek table has a
point for every frame.

Supported are mono streams of 8 or 16 bits with a fixed block size; others raise ValueError, as do
damaged ones. Bytes are stored as samples minus 128.

The media column is stored as a Parquet table and read back; its PCM blocks are a second table, and the
digest is computed from those blocks. `read_range` reads samples by offset.

Defined results: a null or empty text is one frame of padding; a very long text is one stream, coded
and decoded 2,048 frames at a time, and held whole by one worker; repeated rows give equal results;
extra columns are ignored; an empty table gives an empty table; a null doc_id stays null.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, map_batches, materialize, table

BLOCK = 576
PAD = b"\xff"
RATE = 8000
LPC_ORDER, LPC_BITS = 4, 8
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values of the format
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{i: 256 << (i - 8) for i in range(8, 16)}}  # fixed values of the format
MAX_FRAMES = 2048


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Of many byte ranges side by side."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    value = np.zeros(len(order), np.uint16)
    longest = int(left[0]) if len(left) else 0
    live = np.searchsorted(-left, -np.arange(longest), side="left")
    for j in range(longest):
        n = live[j]
        v, b = value[:n], data[at[:n] + j]
        value[:n] = CRC8[(v ^ b) & 255] if bits == 8 else (v << 8) ^ CRC16[(v >> 8) ^ b]
    out = np.empty_like(value)
    out[order] = value
    return out


class Bits:
    """A bit array that fields are scattered into."""

    def __init__(self, n: int):
        self.bits = np.zeros(n, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width) -> np.ndarray:
        """Writes value's low `width` bits at each place; where the next field begins."""
        width = np.broadcast_to(width, at.shape)
        for j in range(int(width.max()) if len(at) else 0):
            on = np.flatnonzero((width > j) & ((value >> np.maximum(width - 1 - j, 0)) & 1).astype(bool))
            self.bits[at[on] + j] = 1
        return at + width


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers coded as in UTF-8 (up to 31 bits): rows of 6 bytes, and how many are used."""
    n = n.astype(np.int64)
    size = 1 + sum((n >= b).astype(np.int64) for b in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        rows = np.flatnonzero(size == s)
        v = n[rows]
        if s == 1:
            out[rows, 0] = v
            continue
        for j in range(s - 1, 0, -1):
            out[rows, j] = 0x80 | (v & 63)
            v = v >> 6
        out[rows, 0] = ((0xFF << (8 - s)) & 0xFF) | v
    return out, size


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order-4 predictor of each row by autocorrelation: integer coefficients, shifts, usable rows. Sums are of integers, so exact."""
    n = LPC_ORDER
    xf = x.astype(np.float64)
    r = np.stack([(xf[:, i:] * xf[:, : xf.shape[1] - i]).sum(axis=1) for i in range(n + 1)], axis=1)
    err = np.maximum(r[:, 0], 1.0)
    a = np.zeros((len(x), n))
    for i in range(n):
        acc = r[:, i + 1] - sum(a[:, j] * r[:, i - j] for j in range(i))
        k = acc / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a = new
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.maximum(top, 1e-9) * 1.0000001)), 0, 15).astype(np.int64)
    q = np.rint(a * (1 << shift)[:, None]).astype(np.int64)
    lim = 1 << (LPC_BITS - 1)
    return q, shift, (np.abs(q) < lim).all(axis=1) & (top > 0)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of BLOCK samples (-128 .. 127) and their frame numbers -> all frames' bytes, and each frame's size."""
    n = len(x)
    x = x.astype(np.int32)
    rows = np.arange(n)
    # residuals of every predictor; the warm-up samples count as nothing
    residual, best = x.copy(), np.abs(x).sum(axis=1)
    order, linear = np.zeros(n, np.int64), np.zeros(n, bool)
    d = x
    for o in range(1, 5):
        d = np.diff(d, axis=1)
        cost = np.abs(d).sum(axis=1) + 8 * o
        win = cost < best
        residual[win, o:] = d[win]
        best, order = np.where(win, cost, best), np.where(win, o, order)
    q, shift, good = _linear(x)
    q32 = q.astype(np.int32)
    p = LPC_ORDER
    pred = sum(q32[:, j, None] * x[:, p - 1 - j : BLOCK - 1 - j] for j in range(p)) >> shift.astype(np.int32)[:, None]
    lres = x[:, p:] - pred
    cost = np.abs(lres).sum(axis=1) + 80
    win = good & (cost < best)
    residual[win, p:] = lres[win]
    order, linear = np.where(win, p, order), win
    u = (residual << 1) ^ (residual >> 31)
    u[np.arange(BLOCK)[None, :] < order[:, None]] = 0
    count = BLOCK - order
    mean = u.sum(axis=1, dtype=np.int64) / count
    guess = np.clip(np.log2(np.maximum(mean, 1)).astype(np.int64), 0, 13)
    size, k = None, None
    for g in (np.maximum(guess - 1, 0), guess, guess + 1):
        s = (u >> g[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64) + count * (1 + g)
        if size is None:
            size, k = s, g
        else:
            k, size = np.where(s < size, g, k), np.minimum(s, size)
    head = 8 * order + np.where(linear, 9 + LPC_BITS * LPC_ORDER, 0) + 10
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (head + size >= 8 * BLOCK)
    rice = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, head + size))
    name, name_size = _utf8_number(number)
    top = 4 + name_size + 1
    length = top + (8 + body + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    out = Bits(int(length.sum()) * 8)
    at = start * 8
    at = out.put(at, np.full(n, 0xFFF82002), 32)
    for j in range(6):
        some = np.where(name_size > j, 8, 0)
        at = out.put(at, name[:, j].astype(np.int64), some)
    at = at + 8  # CRC-8, later
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31 + order, 8 + order)))
    at = out.put(at, kind << 1, 8)
    at = out.put(at, x[:, 0].astype(np.int64) & 255, np.where(constant, 8, 0))
    if verbatim.any():
        v = np.flatnonzero(verbatim)
        out.bits[at[v, None] + np.arange(8 * BLOCK)] = np.unpackbits((x[v] & 255).astype(np.uint8), axis=1)
    for j in range(4):
        at = out.put(at, x[:, j].astype(np.int64) & 255, np.where(rice & (order > j), 8, 0))
    lpc = rice & linear
    at = out.put(at, np.full(n, LPC_BITS - 1), np.where(lpc, 4, 0))
    at = out.put(at, shift, np.where(lpc, 5, 0))
    for j in range(LPC_ORDER):
        at = out.put(at, q[:, j] & ((1 << LPC_BITS) - 1), np.where(lpc, LPC_BITS, 0))
    at = out.put(at, k, np.where(rice, 10, 0))  # method 0, partition order 0, parameter
    r = np.flatnonzero(rice)
    if len(r):
        ur, kr, skip = u[r], k[r].astype(np.int32)[:, None], order[r]
        quot = ur >> kr
        width = quot + (1 + kr)
        width[np.arange(BLOCK)[None, :] < skip[:, None]] = 0
        ends = np.cumsum(width, axis=1, dtype=np.int64) + at[r][:, None]
        live = width.ravel() > 0
        stop = (ends - kr - 1).ravel()[live]
        out.bits[stop] = 1
        rem, kk = ur.ravel()[live], np.broadcast_to(kr, ur.shape).ravel()[live]
        end = stop + kk
        for j in range(int(k[r].max())):  # bit j from the right
            on = (kk > j) & ((rem >> j) & 1).astype(bool)
            out.bits[end[on] - j] = 1
    data = np.packbits(out.bits)
    data[start + top - 1] = crc(data, start, top - 1, 8)
    c = crc(data, start, length - 2, 16)
    data[start + length - 2], data[start + length - 1] = c >> 8, c & 255
    return data, length


def _stream(payload: bytes, frames: bytes, sizes: np.ndarray) -> bytes:
    n = len(payload)
    pcm = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()  # two's complement, as the sum wants it
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    points = np.zeros(len(sizes), np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
    points["s"], points["o"], points["n"] = np.arange(len(sizes)) * BLOCK, offsets, BLOCK
    blocks = [b"\x00" + len(info).to_bytes(3, "big") + info]
    # a metadata block holds 2**24 - 1 bytes; a longer stream's table gets every so many frames
    every = -(-len(points) * 18 // (1 << 23))
    table_ = points[::every].tobytes()
    blocks.append(b"\x83" + len(table_).to_bytes(3, "big") + table_)
    return b"fLaC" + b"".join(blocks) + frames


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % BLOCK if text else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose sizes are positive multiples of BLOCK; frames of all are coded together."""
    counts = [len(p) // BLOCK for p in payloads]
    frames, sizes = [], []
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    for at in range(0, len(flat), MAX_FRAMES):
        data, length = encode_frames(flat[at : at + MAX_FRAMES].astype(np.int16) - 128, number[at : at + MAX_FRAMES])
        frames.append(data)
        sizes.append(length)
    data, size = np.concatenate(frames).tobytes() if frames else b"", np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    out, a, b = [], 0, 0
    for p, c in zip(payloads, counts, strict=True):
        own = size[a : a + c]
        n = int(own.sum())
        out.append(_stream(p, data[b : b + n], own))
        a, b = a + c, b + n
    return out


class Stream:
    """A stream's metadata and the places of its frames."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.data, at, last = data, 4, False
        self.points = np.zeros((0, 3), np.int64)
        info = None
        while not last:
            last, kind, n = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            part = data[at + 4 : at + 4 + n]
            if kind == 0:
                info = part
            elif kind == 3:
                p = np.frombuffer(part, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
                p = p[p["s"] != 0xFFFFFFFFFFFFFFFF]
                self.points = np.stack([p["s"].astype(np.int64), p["o"].astype(np.int64), p["n"].astype(np.int64)], axis=1)
            at += 4 + n
        if info is None:
            raise ValueError("no STREAMINFO")
        low, high = struct.unpack(">HH", info[:4])
        rest = int.from_bytes(info[10:18], "big")
        self.block, self.rate, self.bits = high, rest >> 44, (rest >> 36 & 31) + 1
        self.total, self.md5, self.first = rest & ((1 << 36) - 1), info[18:34], at
        if low != high or rest >> 41 & 7 or self.bits not in (8, 16):
            raise ValueError("only mono streams of 8 or 16 bits with a fixed block size are supported")
        self.starts = self._starts()

    def _starts(self) -> np.ndarray:
        """Places of all frames: the seek points, and between them the sync codes with the right number and CRC."""
        want = -(-self.total // self.block)
        if len(self.points) == want and (self.points[:, 0] == np.arange(want) * self.block).all():
            return self.points[:, 1] + self.first
        raw = np.frombuffer(self.data, np.uint8)
        sync = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0xF8))
        out = []
        for at in sync[sync >= self.first].tolist():
            head = raw[at : at + 16]
            if len(head) < 6 or head[2] & 15 == 15:
                continue
            number, size = _read_number(head[4:])
            end = 4 + size + {6: 1, 7: 2}.get(int(head[2]) >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(int(head[2]) & 15, 0)
            if size and number == len(out) and end < len(head) and int(crc(raw, np.array([at]), np.array([end]), 8)[0]) == raw[at + end]:
                out.append(at)
        if len(out) != want:
            raise ValueError("frames are missing")
        return np.array(out, np.int64)


def _read_number(head: np.ndarray) -> tuple[int, int]:
    b = int(head[0])
    if b < 128:
        return b, 1
    size = 8 - (b ^ 255).bit_length() if b != 255 else 8
    if not 2 <= size <= 7 or len(head) < size:
        return -1, 0
    v = b & ((1 << (7 - size)) - 1)
    for x in head[1:size].tolist():
        v = v << 6 | x & 63
    return v, size


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of streams; frames of all are decoded together. Checksums of frames and of all samples are verified."""
    opened = [Stream(s) for s in streams]
    jobs: dict[tuple, list] = {}
    for i, s in enumerate(opened):
        ends = np.append(s.starts[1:], len(s.data))
        jobs.setdefault((s.block, s.bits), []).append((i, s.starts, ends))
    out: list = [None] * len(streams)
    for (block, bits), group in jobs.items():
        owner = np.concatenate([np.full(len(a), i) for i, a, _ in group])
        base, pos = {}, 0
        for i, _, _ in group:
            base[i] = pos
            pos += len(opened[i].data)
        data = np.frombuffer(b"".join(opened[i].data for i, _, _ in group), np.uint8)
        starts = np.concatenate([a + base[i] for i, a, _ in group])
        ends = np.concatenate([b + base[i] for i, _, b in group])
        first = np.concatenate([np.arange(len(a)) for _, a, _ in group])
        size = np.array([min(block, opened[i].total - k * block) for i, k in zip(owner.tolist(), first.tolist(), strict=True)]) if len(owner) else owner
        rows = np.concatenate([decode_frames(data, starts[j : j + MAX_FRAMES], ends[j : j + MAX_FRAMES], size[j : j + MAX_FRAMES], first[j : j + MAX_FRAMES], block, bits) for j in range(0, len(starts), MAX_FRAMES)]) if len(starts) else np.zeros((0, block), np.int32)
        at = 0
        for i, a, _ in group:
            out[i] = rows[at : at + len(a)].reshape(-1)[: opened[i].total]
            at += len(a)
    for s, x in zip(opened, out, strict=True):
        if any(s.md5) and hashlib.md5(x.astype(np.int8 if s.bits == 8 else "<i2").tobytes()).digest() != s.md5:
            raise ValueError("the samples do not have the stream's sum")
    return out


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, number: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Frames of data[start:end] with `count` samples each -> rows of `block` samples."""
    n = len(start)
    lo = int(start.min())
    data, start, end = data[lo : int(end.max())], start - lo, end - lo
    if (crc(data, start, end - start, 16) != 0).any():  # over a frame with its own CRC-16 it is 0
        raise ValueError("a frame's CRC-16 is wrong")
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data) + 4, np.uint32)
    for j in range(4):
        word |= pad[j : j + len(word)].astype(np.uint32) << np.uint32(24 - 8 * j)

    def read(at: np.ndarray, width) -> np.ndarray:
        """Up to 25 bits from bit `at` on."""
        w = np.broadcast_to(width, at.shape).astype(np.int64)
        return (word[at >> 3].astype(np.int64) >> (32 - (at & 7) - w)) & ((1 << w) - 1)

    def signed(at: np.ndarray, width) -> np.ndarray:
        v = read(at, width)
        return np.where(v >> (np.maximum(width, 1) - 1) & 1, v - (1 << np.asarray(width)), v)

    code, rate = data[start + 2] >> 4, data[start + 2] & 15
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 3] >> 4).any():
        raise ValueError("not a mono frame with a fixed block size")
    lead = data[start + 4]
    name = np.where(lead < 128, 1, np.select([lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [2, 3, 4, 5, 6], 7))
    head = 4 + name + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (crc(data, start, head, 8) != data[start + head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    at = (start + head + 1) * 8
    kind = read(at, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not supported")
    kind >>= 1
    at = at + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("reserved subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    x = np.zeros((block, n), np.int64)  # a column for each frame, so that a step is one row
    c = np.flatnonzero(constant)
    if len(c):
        x[:, c] = signed(at[c], bits)
    v = np.flatnonzero(verbatim)
    for i in range(block if len(v) else 0):
        x[i, v] = signed(at[v] + bits * i, bits)
    f = np.flatnonzero(fixed | linear)
    if not len(f):
        return x.T.astype(np.int32)
    f = f[np.argsort(order[f], kind="stable")]
    pos, o, m = at[f], order[f], count[f]
    most = int(o.max())
    warm = np.zeros((most, len(f)), np.int64)
    for i in range(most):
        on = o > i
        warm[i, on] = signed(pos[on], bits)
        pos = pos + np.where(on, bits, 0)
    coef, shift = np.zeros((max(most, 1), len(f)), np.int64), np.zeros(len(f), np.int64)
    for i, row in enumerate(FIXED):
        on = fixed[f] & (o == i)
        for j, value in enumerate(row if on.any() else ()):
            coef[j, on] = value
    lin = np.flatnonzero(linear[f])
    if len(lin):
        precision, sh = read(pos[lin], 4) + 1, signed(pos[lin] + 4, 5)
        if (precision == 16).any() or (sh < 0).any():
            raise ValueError("invalid linear predictor")
        shift[lin] = sh
        p = pos[lin] + 9
        for j in range(most):
            on = o[lin] > j
            coef[j, lin[on]] = signed(p[on], precision[on])
            p = p + np.where(on, precision, 0)
        pos[lin] = p
    method, parts = read(pos, 2), 1 << read(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    pos = pos + 6
    field = 4 + method
    last = (1 << field) - 1
    each = m // parts
    bits_ = np.unpackbits(data)
    ones = np.flatnonzero(bits_).astype(np.int64)
    before = np.zeros(len(bits_) + 1, np.int32)
    np.cumsum(bits_, out=before[1:])
    residual = np.zeros((block, len(f)), np.int64)
    k, raw = np.zeros(len(f), np.int64), np.full(len(f), -1)
    fresh = o.copy()  # at which sample the next partition begins
    fresh_end = each.copy()
    begun = np.searchsorted(o, np.arange(block), side="right")  # frames whose warm-up is over
    simple = bool((parts == 1).all())
    same = bool((m == block).all())
    for i in range(block):
        w = int(begun[i])
        if not w:
            continue
        # a first partition that the warm-up fills has a parameter and no residual: the next begins at the same sample
        while (not simple or i <= most) and len(due := np.flatnonzero((fresh[:w] == i) & (i < m[:w]))):
            value = read(pos[due], field[due])
            pos[due] += field[due]
            esc = value == last[due]
            k[due], raw[due] = value, -1
            if esc.any():
                e = due[esc]
                raw[e] = read(pos[e], 5)
                pos[e] += 5
            fresh[due] = fresh_end[due]
            fresh_end[due] += each[due]
        at_, kk = pos[:w], k[:w]
        stop = ones[np.minimum(before[at_], len(ones) - 1)]
        low = stop + 1
        rem = (word[low >> 3].astype(np.int64) >> (32 - (low & 7) - kk)) & ((1 << kk) - 1)
        u = ((stop - at_) << kk) | rem
        value, new = (u >> 1) ^ -(u & 1), low + kk
        if (raw[:w] >= 0).any():
            e = np.flatnonzero(raw[:w] >= 0)
            value[e] = np.where(raw[e] > 0, signed(at_[e], np.maximum(raw[e], 1)), 0)
            new[e] = at_[e] + raw[e]
        if not same:
            over = i >= m[:w]
            value[over], new[over] = 0, at_[over]
        residual[i, :w] = value
        pos[:w] = new
    y = np.zeros((block, len(f)), np.int64)
    for i in range(block):
        y[i] = residual[i]
        w = int(begun[i])
        if i < most:
            y[i, w:] = warm[i, w:]
        if w and i:
            pred = coef[0, :w] * y[i - 1, :w]
            for j in range(1, min(most, i)):
                pred = pred + coef[j, :w] * y[i - 1 - j, :w]
            y[i, :w] += pred >> shift[:w]
    x[:, f] = y
    return x.T.astype(np.int32)


# ---- columns


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text's UTF-8), media (a FLAC stream of its padded bytes)."""

    def factory():
        def run(batch):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            media = encode([padded(x) for x in texts])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return run

    return map_batches(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text")], factory, "doc_id long, n_bytes long, media binary", rows=512)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of encode_column, read back, with `row`: a number of each stored row."""
    return materialize(encode_column(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "media", "zstd")


def pcm_blocks(media: DataFrame, block_samples: int = 1 << 16, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """PCM blocks: the columns `keep` of media, then block, n_blocks, sample_offset, n_samples, pcm (unsigned 8 bit, or little-endian
    signed 16 bit), media_bytes and media_sha256 of the stream they come from. Null media give none."""

    def factory():
        def run(batch):
            streams = batch.column(len(keep)).to_pylist()
            some = [i for i, s in enumerate(streams) if s is not None]
            at, rows = [], []
            for i, x in zip(some, decode([streams[i] for i in some]), strict=True):
                deep = Stream(streams[i]).bits == 16
                says = len(streams[i]), hashlib.sha256(streams[i]).hexdigest()
                n = -(-len(x) // block_samples)
                for b in range(n):
                    part = x[b * block_samples : (b + 1) * block_samples]
                    at.append(i)
                    rows.append((b, n, b * block_samples, len(part), part.astype("<i2").tobytes() if deep else (part + 128).astype(np.uint8).tobytes(), *says))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            kept = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(len(keep))]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*keep, *BLOCKS])

        return run

    own = T.StructType([media.schema[c] for c in keep])
    for name, kind in zip(BLOCKS, ("integer", "integer", "long", "long", "binary", "long", "string"), strict=True):
        own = own.add(name, kind)
    return map_batches(media, [*keep, media_col], factory, own, rows=256)


BLOCKS = ("block", "n_blocks", "sample_offset", "n_samples", "pcm", "media_bytes", "media_sha256")


def read_range(blocks: DataFrame, doc_id: int, start: int, count: int, width: int = 1) -> bytes:
    """Samples [start, start + count) of a document from the blocks that hold them; `width` bytes a sample. Offsets are filters of the scan."""
    end = start + count
    some = blocks.where((F.col("doc_id") == doc_id) & (F.col("sample_offset") < end) & (F.col("sample_offset") + F.col("n_samples") > start))
    rows = some.select("sample_offset", "pcm").orderBy("sample_offset").collect()  # as many as the range asked for spans
    first = rows[0].sample_offset if rows else 0
    return b"".join(bytes(r.pcm) for r in rows)[max(start - first, 0) * width : max(end - first, 0) * width]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(payload: bytes) -> tuple[int, str, int, str]:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    feature = f"frames={len(x) // BLOCK};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};low={int(x.min())};high={int(x.max())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature


def _digests(ids, sizes, payloads, media_bytes, media_sums) -> pa.RecordBatch:
    found = [_digest(p) for p in payloads]
    size, sums, tails, features = ([f[j] for f in found] for j in range(4))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = (ids, sizes, size, sums, tails, media_bytes, media_sums, features)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])


def block_digest(blocks: DataFrame) -> DataFrame:
    """Per stored row, from its PCM blocks (of pcm_blocks with row, doc_id and n_bytes): payload and media sums, and features of the samples.

    Blocks of a row that has several are put together again by row and place; the others stay where they are.
    """
    used = ["doc_id", "n_bytes", "pcm", "media_bytes", "media_sha256"]

    def factory():
        def run(batch):
            return _digests(*(batch.column(i).to_pylist() for i in range(5)))

        return run

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        if group["block"].to_pylist() != list(range(group["n_blocks"][0].as_py())):
            raise ValueError("PCM blocks are missing")
        one = group.slice(0, 1).to_pydict()
        return pa.Table.from_batches([_digests(one["doc_id"], one["n_bytes"], [b"".join(group["pcm"].to_pylist())], one["media_bytes"], one["media_sha256"])])

    single = map_batches(blocks.where("n_blocks = 1"), used, factory, DIGEST, rows=512)
    several = blocks.where("n_blocks > 1").select("row", "block", "n_blocks", *used).groupBy("row").applyInArrow(whole, DIGEST)
    return single.unionByName(several)


def media_digest(docs: DataFrame, waves: int = 4) -> DataFrame:
    """Every text stored as FLAC, read back, written as PCM blocks and digested from these.

    Media and blocks take more room than the texts, so rows go in `waves` by hash; a wave's two tables are
    deleted when its digests have been written. All rows are in a wave.
    """
    out = []
    rows = docs.select("doc_id", "text")
    for i in range(waves):
        media = store_media(rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(waves)) == i))
        blocks = materialize(pcm_blocks(media, keep=("row", "doc_id", "n_bytes")), "blocks", "zstd")
        forget(media)
        out.append(materialize(block_digest(blocks), "digests"))
        forget(blocks)
    return functools.reduce(DataFrame.unionByName, out)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
