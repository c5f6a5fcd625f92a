"""Pixels of images: PNG of all depths and interlaced, GIF frame by frame, plain BMP; and PNG files made of pixels.

Pixels are arrays (height, width, red green blue alpha) of bytes; what is damaged or of another kind gives None.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Images of more pixels aren't decoded.
MOST_PIXELS = 1 << 26
# Samples of a pixel by PNG colour type; where the passes of an interlaced PNG begin and how far apart they go (x, y),
# and where those of an interlaced GIF begin and go (y).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
ROWS = ((0, 8), (4, 8), (2, 4), (1, 2))


def _unfiltered(raw: bytes, at: int, height: int, size: int, step: int) -> tuple[np.ndarray, int]:
    """Rows of ``size`` bytes from ``at`` on, each behind a byte for its filter; step: bytes to the left neighbour."""
    rows = np.zeros((height + 1, size + step), np.uint8)  # a row above and a pixel to the left of zeros
    for y in range(height):
        kind, line, above = raw[at], np.frombuffer(raw, np.uint8, size, at + 1).astype(np.int64), rows[y].astype(np.int64)
        at += size + 1
        if kind == 0:
            out = line
        elif kind == 1:
            whole = np.concatenate([line, np.zeros(-size % step, np.int64)]).reshape(-1, step)
            out = np.cumsum(whole, axis=0).ravel()[:size]
        elif kind == 2:
            out = line + above[step:]
        elif kind in (3, 4):
            held, up = [0] * step, above.tolist()
            for i, x in enumerate(line.tolist()):
                a, b, c = held[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                held.append((x + guess) % 256)
            out = np.array(held[step:], np.int64)
        else:
            raise ValueError("filter")
        rows[y + 1, step:] = out % 256
    return rows[1:, step:], at


def _samples(rows: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """(height, width, n) of the numbers in rows of bytes."""
    if depth == 8:
        return rows.reshape(len(rows), width, n)
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(len(rows), width, n)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * n].reshape(len(rows), width, n)


def decode_png(data: bytes) -> np.ndarray | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette, clear, head = 8, [], None, b"", None
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return None
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[3] not in SAMPLES or head[2] not in (1, 2, 4, 8, 16) or (head[2] < 8 and head[3] not in (0, 3)) or (head[2] == 16 and head[3] == 3) or head[6] > 1:
        return None
    width, height, depth, colour, interlaced = head[0], head[1], head[2], head[3], head[6]
    n = SAMPLES[colour]
    if not width * height or width * height > MOST_PIXELS:
        return None
    found = np.zeros((height, width, n), np.uint16)
    try:
        raw, at = zlib.decompress(b"".join(packed)), 0
        for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                rows, at = _unfiltered(raw, at, h, -(-w * n * depth // 8), max(1, n * depth // 8))
                found[y::dy, x::dx] = _samples(rows, w, n, depth)
    except (zlib.error, ValueError, IndexError):
        return None
    return _coloured(found, depth, colour, palette, clear)


def _coloured(found: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, clear: bytes) -> np.ndarray | None:
    """Samples as red, green, blue and alpha of eight bits."""
    if colour == 3:
        if palette is None or int(found.max()) >= len(palette):
            return None
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return np.concatenate([palette[found[..., 0]], alpha[found]], axis=2)
    scaled = (found >> 8 if depth == 16 else found * (255 // ((1 << depth) - 1))).astype(np.uint8)
    opaque = np.full((*found.shape[:2], 1), 255, np.uint8)
    if colour in (0, 2):
        if len(clear) == 2 * found.shape[2]:
            opaque[(found == np.frombuffer(clear, ">u2")).all(axis=2)] = 0
        return np.concatenate([np.repeat(scaled, 3, axis=2) if colour == 0 else scaled, opaque], axis=2)
    return np.concatenate([np.repeat(scaled[..., :1], 3, axis=2), scaled[..., 1:]], axis=2) if colour == 4 else scaled


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width, red green blue); equal pixels give equal bytes."""
    height, width, _ = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


# GIF ----------------------------------------------------------------------------------------------------------------------


def unpacked(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` numbers of a stream of LZW codes that starts with codes of ``bits`` + 1 bits; zeros where it ends early."""
    clear, end = 1 << bits, (1 << bits) + 1
    words = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out, size, held, have, before = bytearray(), bits + 1, 0, 0, b""
    for byte in data:
        held |= byte << have
        have += 8
        while have >= size:
            code, held, have = held & ((1 << size) - 1), held >> size, have - size
            if code == clear:
                del words[end + 1 :]
                size, before = bits + 1, b""
                continue
            if code == end or len(out) >= count:
                return _padded(out, count)
            if code > len(words) or (code == len(words) and not before):
                raise ValueError("code")
            word = words[code] if code < len(words) else before + before[:1]
            out += word
            if before and len(words) < 4096:
                words.append(before + word[:1])
                size += len(words) == 1 << size and size < 12
            before = word
    return _padded(out, count)


def _padded(out: bytearray, count: int) -> np.ndarray:
    return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of the sub-blocks from a place on, and where they end."""
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def gif_frames(data: bytes) -> Iterator[np.ndarray]:
    """The picture after each frame: drawn over what the frames before it have left, which they may clear or take back."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MOST_PIXELS:
        return
    at, shared = 13, None
    if flags & 0x80:
        shared, at = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3), at + (3 << (flags & 7) + 1)
    picture, disposal, clear = np.zeros((height, width, 4), np.uint8), 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            return
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if flags & 0x80:
            palette, at = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3), at + (3 << (flags & 7) + 1)
        body, after = _blocks(data, at + 1)
        numbers = unpacked(body, data[at], w * h).reshape(h, w)
        at = after
        if palette is None or w * h > MOST_PIXELS:
            return
        if flags & 0x40:
            order = [y for first, step in ROWS for y in range(first, h, step)]
            numbers = numbers[np.argsort(order)]
        before = picture.copy()
        part = picture[top : top + h, left : left + w]
        numbers = numbers[: part.shape[0], : part.shape[1]]
        drawn = np.full(numbers.shape, True) if clear is None else numbers != clear
        colours = palette[np.minimum(numbers, len(palette) - 1)]
        part[drawn] = np.concatenate([colours, np.full((*numbers.shape, 1), 255, np.uint8)], axis=2)[drawn]
        yield picture.copy()
        if disposal == 2:
            part[...] = 0
        elif disposal == 3:
            picture = before
        disposal, clear = 0, None


def decode_gif(data: bytes, frame: int = 0) -> np.ndarray | None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    try:
        return next((p for k, p in enumerate(gif_frames(data)) if k == frame), None)
    except (ValueError, IndexError, struct.error):
        return None


def gif_is_transparent(data: bytes) -> bool:
    """Whether some frame of a GIF has a colour that is clear."""
    at = data.find(b"\x21\xf9\x04")
    while 0 <= at < len(data) - 4:
        if data[at + 3] & 1:
            return True
        at = data.find(b"\x21\xf9\x04", at + 1)
    return False


def decode_bmp(data: bytes) -> np.ndarray | None:
    """Of 24 or 32 bits a pixel, not compressed."""
    try:
        if data[:2] != b"BM":
            return None
        start, width, height, bits, packing = (*struct.unpack("<I", data[10:14]), *struct.unpack("<ii", data[18:26]), *struct.unpack("<H", data[28:30]), *struct.unpack("<I", data[30:34]))
        rows = abs(height)
        if bits not in (24, 32) or packing or not 0 < width * rows <= MOST_PIXELS:
            return None
        stride = -(-width * bits // 32) * 4
        raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8].reshape(rows, width, bits // 8)
    except (struct.error, ValueError):
        return None
    raw = raw[::-1] if height > 0 else raw
    return np.concatenate([raw[..., 2::-1], np.full((rows, width, 1), 255, np.uint8)], axis=2)


def decode(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG, of the first frame of a GIF, or of a plain BMP."""
    found = decode_png(data)
    found = decode_gif(data) if found is None else found
    return decode_bmp(data) if found is None else found
