"""Blocks of an archive: slots of hunks, parity of sectors, codecs of hunks, bits. Plain numpy, for use inside tasks.

A hunk is a whole number of slots; a slot is a raw sector and its subcode. The framed codecs hold
a bitmap of sectors whose parity was left out, the length of the sector block, that block and the
subcode block. The audio codec holds bare FLAC frames and the deflated subcode.
"""

from __future__ import annotations

import binascii
import lzma
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

SECTOR, SUBCODE, SLOT, HUNK_SLOTS = 2352, 96, 2448, 8
HUNK = SLOT * HUNK_SLOTS
SYNC = np.frombuffer(b"\0" + b"\xff" * 10 + b"\0", np.uint8)
#: The parity fields as (first byte written, codewords, symbols of each, step of a pair of codewords, step of a symbol).
PARITY = ((2076, 86, 24, 2, 86), (2248, 52, 43, 86, 88))
#: Sectors from which on parity is computed side by side.
MANY = 64
#: Fixed value: decoded bytes that a zstandard block may have at most.
ZSTD_MOST = 16 << 20


class BadBlock(ValueError):
    """A block that does not decode."""


def crc16(data: bytes) -> int:
    return binascii.crc_hqx(data, 0xFFFF)


# Slots of hunks


def slot_blocks(size: int = 1 << 16) -> Callable[[int, int, int], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """A function (start, total, frames) that lays out every slot of a track in order, ``size`` at a time.

    A block is the hunk of its first slot, and of each slot its hunk counted from there, its place
    in the hunk and whether it is padding. All blocks are in the same memory: copy what is kept.
    A block of 2^16 sums up within 32 bits.
    """
    lba = np.arange(size + HUNK_SLOTS, dtype=np.int32)
    hunk, slot, padding = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, bool)
    shift = HUNK_SLOTS.bit_length() - 1

    def blocks(start: int, total: int, frames: int):
        for at in range(0, total, size):
            n = min(size, total - at)
            first, skip = divmod(start + at, HUNK_SLOTS)
            own = lba[skip : skip + n]
            yield first, np.right_shift(own, shift, out=hunk[:n]), np.bitwise_and(own, HUNK_SLOTS - 1, out=slot[:n]), np.greater_equal(lba[:n], min(max(frames - at, 0), n), out=padding[:n])

    return blocks


# Parity of sectors


@lru_cache(1)
def products() -> np.ndarray:
    """products()[a, b]: a times b in the field of 256 elements with x^8 = x^4 + x^3 + x^2 + 1."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    table = power[log[:, None] + log[None, :]]
    table[0], table[:, 0] = 0, 0
    return table


@lru_cache(2)
def codewords(field: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte of each symbol (codeword, symbol) past the sync, and each symbol's weight in the first check byte.

    Both check bytes are linear: their sum is the sum of all symbols, and the first is the sum of
    symbols times (2^(symbols to the end + 1) + 1) / 3.
    """
    _, count, symbols, pair, step = PARITY[field]
    major = np.arange(count)[:, None]
    at = (major // 2 * pair + major % 2 + np.arange(symbols) * step) % (count * symbols)
    times, third = products(), int(np.flatnonzero(products()[3] == 1)[0])
    weight, power = np.zeros(symbols, np.uint8), 2
    for k in range(symbols - 1, -1, -1):
        power = int(times[2, power])
        weight[k] = times[third, power ^ 1]
    return at, weight


def with_parity(sectors: np.ndarray) -> np.ndarray:
    """Sectors (n, 2352) with sync and both parity fields as they have to be.

    A hunk's few sectors are multiplied out by a table. Many sectors lie side by side, so that a
    symbol of all of them is one row; a weighted sum is then the sums of the rows whose weight has
    a bit, from the highest bit down, doubled at each step.
    """
    out = sectors.copy()
    out[:, :12] = SYNC
    for field, (first, count, symbols, *_) in enumerate(PARITY):
        at, weight = codewords(field)
        body = out[:, 12:first].copy()
        body[out[:, 15] == 2, :4] = 0  # mode 2 counts its address as zero
        if len(out) < MANY:
            parts = body[:, at]
            total = np.bitwise_xor.reduce(parts, axis=2)
            head = np.bitwise_xor.reduce(products()[weight, parts], axis=2)
            out[:, first : first + 2 * count] = np.concatenate((head, head ^ total), axis=1)
            continue
        body = np.ascontiguousarray(body.T)
        rows = [body[at[:, k]] for k in range(symbols)]
        total, head = np.bitwise_xor.reduce(rows), np.zeros((count, len(out)), np.uint8)
        for bit in range(7, -1, -1):
            head = head << 1 ^ (head >> 7) * np.uint8(0x1D)
            for k in np.flatnonzero(weight >> bit & 1):
                head ^= rows[k]
        out[:, first : first + count], out[:, first + count : first + 2 * count] = head.T, (head ^ total).T
    return out


def strip(sectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sectors without what can be made anew, which ones): only sectors that come back exactly."""
    gone = (sectors[:, :12] == SYNC).all(axis=1)
    if gone.any():
        some = np.flatnonzero(gone)
        gone[some] = (with_parity(sectors[some]) == sectors[some]).all(axis=1)
    out = sectors.copy()
    out[gone, :12], out[gone, PARITY[0][0] :] = 0, 0
    return out, gone


# Inner codecs: (block, bytes wanted) -> bytes


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(-1, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate(block: bytes, want: int) -> bytes:
    try:
        out = zlib.decompressobj(-15).decompress(block, want)
    except zlib.error as e:
        raise BadBlock(f"deflate: {e}") from e
    if len(out) != want:
        raise BadBlock(f"deflate gave {len(out)} bytes of {want}")
    return out


def unlzma(block: bytes, want: int) -> bytes:
    kind = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": max(want, 4096)}
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[kind]).decompress(block, want)
    except lzma.LZMAError as e:
        raise BadBlock(f"lzma: {e}") from e
    if len(out) != want:
        raise BadBlock(f"lzma gave {len(out)} bytes of {want}")
    return out


def unzstd(block: bytes, want: int) -> bytes:
    import zstandard

    if want > ZSTD_MOST:
        raise BadBlock(f"zstandard: {want} bytes are more than {ZSTD_MOST}")
    try:
        with zstandard.ZstdDecompressor().stream_reader(block) as r:
            out = r.read(want + 1)
    except zstandard.ZstdError as e:
        raise BadBlock(f"zstandard: {e}") from e
    if len(out) != want:
        raise BadBlock(f"zstandard gave {len(out)} bytes of {want}")
    return out


# FLAC frames


@lru_cache(2)
def crc_table(width: int, poly: int) -> list[int]:
    table = []
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = c << 1 ^ (poly if c >> (width - 1) else 0)
            c &= (1 << width) - 1
        table.append(c)
    return table


def crc(data: bytes, width: int, poly: int) -> int:
    table, low, c = crc_table(width, poly), width - 8, 0
    for b in data:
        c = table[(c >> low) ^ b] ^ (c << 8 & ((1 << width) - 1))
    return c


class Bits:
    """Bits of a block, first bit highest."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        end = self.at + n
        if end > len(self.bits):
            raise BadBlock("the bits end early")
        value = 0
        for b in self.bits[self.at : end].tolist():
            value = value << 1 | b
        self.at = end
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def table(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of n bits."""
        end = self.at + count * n
        if end > len(self.bits):
            raise BadBlock("the bits end early")
        if not n:
            return np.zeros(count, np.int64)
        v = self.bits[self.at : end].reshape(count, n) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        self.at = end
        return np.where(v >> (n - 1), v - (1 << n), v)

    def unary(self) -> int:
        ones = np.flatnonzero(self.bits[self.at : self.at + 64])
        if not len(ones):
            ones = np.flatnonzero(self.bits[self.at :])
        if not len(ones):
            raise BadBlock("the bits end early")
        self.at += int(ones[0]) + 1
        return int(ones[0])

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` Rice numbers: starts are chased one by one, all else is done at once."""
        if not count:
            return np.zeros(0, np.int64)
        size = min(len(self.bits) - self.at, count * (k + 6) + 64)
        while True:
            part = self.bits[self.at : self.at + size]
            ones = np.flatnonzero(part)
            after = np.searchsorted(ones, np.arange(size)).tolist()
            where, starts, p = ones.tolist(), [], 0
            for _ in range(count):
                if p >= size or after[p] >= len(where):
                    break
                starts.append(p)
                p = where[after[p]] + 1 + k
            if len(starts) == count and p <= size:
                break
            if size == len(self.bits) - self.at:
                raise BadBlock("the bits end early")
            size = min(len(self.bits) - self.at, 2 * size)
        start = np.array(starts)
        one = ones[np.searchsorted(ones, start)]
        value = (one - start).astype(np.int64)
        for i in range(k):
            value = value << 1 | part[one + 1 + i]
        self.at += p
        return value >> 1 ^ -(value & 1)


def predicted(warm: np.ndarray, residual: np.ndarray, order: int) -> np.ndarray:
    """Samples of a fixed predictor: its order-th differences summed up that many times."""
    d, heads = warm.astype(np.int64), []
    for _ in range(order):
        heads.append(int(d[0]))
        d = np.diff(d)
    out = residual
    for head in reversed(heads):
        out = np.cumsum(np.concatenate(([head], out)))
    return out


def subframe(b: Bits, n: int, depth: int) -> np.ndarray:
    if b.take(1):
        raise BadBlock("flac: a subframe starts with a one")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
        depth -= wasted
    if kind == 0:
        out = np.full(n, b.signed(depth), np.int64)
    elif kind == 1:
        out = b.table(n, depth)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm = b.table(order, depth)
        if kind >= 32:
            bits = b.take(4) + 1
            shift, weights = b.signed(5), b.table(order, bits)
        residual = residuals(b, n, order)
        if kind < 32:
            out = predicted(warm, residual, order)
        else:
            past, w = warm.tolist(), weights[::-1].tolist()
            for r in residual.tolist():
                past.append(r + (sum(x * y for x, y in zip(w, past[-order:])) >> shift))
            out = np.array(past, np.int64)
    else:
        raise BadBlock(f"flac: subframe kind {kind}")
    return out << wasted


def residuals(b: Bits, n: int, order: int) -> np.ndarray:
    method = b.take(2)
    if method > 1:
        raise BadBlock(f"flac: residual method {method}")
    width, parts = 4 + method, 1 << b.take(4)
    if n % parts or n // parts < order:
        raise BadBlock("flac: partitions do not divide the block")
    out = []
    for i in range(parts):
        k, count = b.take(width), n // parts - (order if i == 0 else 0)
        out.append(b.table(count, b.take(5)) if k == (1 << width) - 1 else b.rice(count, k))
    return np.concatenate(out)


def flac_frame(data: bytes) -> tuple[np.ndarray, int]:
    """((samples, 2) of the first frame, its bytes): 16 bits, two channels."""
    b = Bits(data)
    if b.take(15) != 0x7FFC:
        raise BadBlock("flac: no frame starts here")
    b.take(1)
    size, rate, channels, depth = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    while lead & 0x40 and lead & 0x80:  # bytes that follow in the frame's number
        b.take(8)
        lead = lead << 1 & 0xFF
    if size in (6, 7):
        n = b.take(8 * (size - 5)) + 1
    elif size == 1:
        n = 192
    elif 2 <= size <= 5:
        n = 576 << (size - 2)
    elif size >= 8:
        n = 256 << (size - 8)
    else:
        raise BadBlock("flac: reserved block size")
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if b.take(8) != crc(data[: b.at // 8 - 1], 8, 0x07):
        raise BadBlock("flac: header checksum")
    if channels not in (1, 8, 9, 10):
        raise BadBlock("flac: not two channels")
    if depth not in (0, 4):
        raise BadBlock("flac: not 16 bits")
    first = subframe(b, n, 16 + (channels == 9))
    second = subframe(b, n, 16 + (channels in (8, 10)))
    if channels == 8:
        second = first - second
    elif channels == 9:
        first = first + second
    elif channels == 10:
        mid = first << 1 | second & 1
        first, second = (mid + second) >> 1, (mid - second) >> 1
    b.at = -(-b.at // 8) * 8
    end = b.at // 8
    if b.take(16) != crc(data[:end], 16, 0x8005):
        raise BadBlock("flac: frame checksum")
    return np.stack((first, second), 1), end + 2


def packed(values: np.ndarray, n: int) -> np.ndarray:
    """Bits of numbers, n each, first bit highest."""
    return (values[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel()


def rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    folded = residual << 1 ^ residual >> 63
    quotient = folded >> k
    start = np.cumsum(quotient + 1 + k) - (quotient + 1 + k)
    bits, one = np.zeros(int((quotient + 1 + k).sum()), np.uint8), start + quotient
    bits[one] = 1
    for i in range(k):
        bits[one + 1 + i] = folded >> (k - 1 - i) & 1
    return bits


def subframe_bits(x: np.ndarray, depth: int) -> np.ndarray:
    """The shortest of: constant, verbatim, a fixed predictor with one partition."""
    if (x == x[0]).all():
        return np.concatenate((packed(np.array([0]), 8), packed(x[:1], depth)))
    best, size = None, len(x) * depth
    for order in range(5):
        r = np.diff(x, order)
        folded = r << 1 ^ r >> 63
        for k in range(15):
            need = order * depth + 10 + int((folded >> k).sum()) + len(r) * (k + 1)
            if need < size:
                best, size = (order, k, r), need
    if best is None:
        return np.concatenate((packed(np.array([2]), 8), packed(x, depth)))
    order, k, r = best
    return np.concatenate((packed(np.array([(8 + order) << 1]), 8), packed(x[:order], depth), packed(np.array([k]), 10), rice_bits(r, k)))


def flac_bytes(x: np.ndarray, number: int) -> bytes:
    """One frame of (samples, 2) at 44.1 kHz: independent channels, or left and difference if shorter."""
    left, right = x[:, 0].astype(np.int64), x[:, 1].astype(np.int64)
    first, plain, side = subframe_bits(left, 16), subframe_bits(right, 16), subframe_bits(left - right, 17)
    channels, second = (8, side) if len(side) < len(plain) else (1, plain)
    head = bytes((0xFF, 0xF8, 0x79, channels << 4 | 8, number)) + (len(x) - 1).to_bytes(2, "big")
    frame = head + bytes((crc(head, 8, 0x07),)) + np.packbits(np.concatenate((first, second))).tobytes()
    return frame + crc(frame, 16, 0x8005).to_bytes(2, "big")


# Hunks


def split(hunk: bytes) -> tuple[np.ndarray, bytes]:
    slots = np.frombuffer(hunk, np.uint8).reshape(-1, SLOT)
    return slots[:, :SECTOR], slots[:, SECTOR:].tobytes()


def joined(sectors: np.ndarray, subcode: bytes) -> bytes:
    return np.concatenate((sectors, np.frombuffer(subcode, np.uint8).reshape(-1, SUBCODE)), axis=1).tobytes()


def unframed(inner: Callable[[bytes, int], bytes], sub: Callable[[bytes, int], bytes]) -> Callable[[bytes, int], bytes]:
    def decode(block: bytes, size: int) -> bytes:
        n = size // SLOT
        flags, wide = -(-n // 8), 3 if size >= 1 << 16 else 2
        at = flags + wide
        end = at + int.from_bytes(block[flags:at], "big")
        if len(block) < at or end > len(block):
            raise BadBlock("the sector block is longer than the hunk")
        sectors = np.frombuffer(inner(block[at:end], n * SECTOR), np.uint8).reshape(n, SECTOR)
        gone = np.unpackbits(np.frombuffer(block[:flags], np.uint8), bitorder="little")[:n].astype(bool)
        if gone.any():
            sectors = sectors.copy()
            sectors[gone] = with_parity(sectors[gone])
        return joined(sectors, sub(block[end:], n * SUBCODE))

    return decode


def unflac(block: bytes, size: int) -> bytes:
    n, parts, got, at = size // SLOT, [], 0, 0
    while got < n * SECTOR // 4:
        samples, used = flac_frame(block[at:])
        parts.append(samples)
        got, at = got + len(samples), at + used
    if got != n * SECTOR // 4:
        raise BadBlock("flac: frames do not fit the hunk")
    sectors = np.concatenate(parts).astype(">i2").view(np.uint8).reshape(n, SECTOR)
    return joined(sectors, inflate(block[at:], n * SUBCODE))


DECODERS: dict[str, Callable[[bytes, int], bytes]] = {"cdzl": unframed(inflate, inflate), "cdlz": unframed(unlzma, inflate), "cdzs": unframed(unzstd, unzstd), "cdfl": unflac}


def framed(hunk: bytes) -> bytes:
    sectors, subcode = split(hunk)
    left, gone = strip(sectors)
    block = deflate(left.tobytes())
    return np.packbits(gone, bitorder="little").tobytes() + len(block).to_bytes(3 if len(hunk) >= 1 << 16 else 2, "big") + block + deflate(subcode)


def flac(hunk: bytes) -> bytes:
    sectors, subcode = split(hunk)
    samples = np.ascontiguousarray(sectors).view(">i2").reshape(-1, 2)
    frames = [flac_bytes(samples[i : i + SECTOR], k) for k, i in enumerate(range(0, len(samples), SECTOR))]
    return b"".join(frames) + deflate(subcode)


def encode(hunk: bytes, audio: bool, codecs: tuple[str, ...]) -> tuple[int | None, bytes]:
    """(slot of the codec, block): FLAC only if strictly shorter, (None, hunk) where nothing is shorter."""
    kind, block = 0, framed(hunk)
    if audio and "cdfl" in codecs:
        other = flac(hunk)
        if len(other) < len(block):
            kind, block = codecs.index("cdfl"), other
    return (kind, block) if len(block) < len(hunk) else (None, hunk)


def swapped(sectors: bytes) -> bytes:
    """Bytes of each pair exchanged: archives hold audio big-endian."""
    return np.frombuffer(sectors, np.uint16).byteswap().tobytes()
