"""Images whose pixels are known when they are made."""
import struct
import zlib

import numpy as np
import pytest

from galley.functions import pixels
from galley.operators import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed_rows(samples, depth, rng):
    """Filtered rows of (height, width, n) samples, with a filter of chance for each row."""
    height, width, n = samples.shape
    if depth == 16:
        raw = samples.astype(">u2").reshape(height, -1).view(np.uint8)
    elif depth == 8:
        raw = samples.astype(np.uint8).reshape(height, -1)
    else:
        bits = ((samples.reshape(height, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(height, -1)
        raw = np.packbits(bits, axis=1)
    step, out, above = max(1, n * depth // 8), b"", [0] * raw.shape[1]
    for row in raw.tolist():
        kind = int(rng.integers(0, 5))
        left = [0] * step + row
        corner = [0] * step + above
        line = []
        for i, x in enumerate(row):
            a, b, c = left[i], above[i], corner[i]
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
        above = row
    return out


def make_png(samples, depth, colour, interlaced, rng, palette=b"", clear=b""):
    height, width, _ = samples.shape
    parts = [samples[y::dy, x::dx] for x, y, dx, dy in (pixels.PASSES if interlaced else ((0, 0, 1, 1),))]
    raw = b"".join(packed_rows(p, depth, rng) for p in parts if p.size)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


KINDS = [(d, c) for d in (1, 2, 4, 8, 16) for c in (0, 2, 3, 4, 6) if not (d < 8 and c not in (0, 3)) and not (d == 16 and c == 3)]


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize(("depth", "colour"), KINDS)
def test_png_of_all_kinds(depth, colour, interlaced):
    rng = np.random.default_rng(depth * 10 + colour)
    for height, width in ((1, 1), (3, 2), (9, 13), (17, 8)):
        n = pixels.SAMPLES[colour]
        samples = rng.integers(0, 1 << depth, (height, width, n))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if colour == 3 else None
        clear = bytes([0, 90]) if colour == 3 else struct.pack(f">{n}H", *samples[0, 0]) if colour in (0, 2) else b""
        got = pixels.decode(make_png(samples, depth, colour, interlaced, rng, palette.tobytes() if colour == 3 else b"", clear))
        eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        if colour == 3:
            want = np.concatenate([palette[samples[..., 0]], np.array([0, 90] + [255] * 254)[samples]], axis=2)
        elif colour in (4, 6):
            want = np.concatenate([np.repeat(eight[..., :1], 3, axis=2), eight[..., 1:]], axis=2) if colour == 4 else eight
        else:
            alpha = np.where((samples == samples[0, 0]).all(axis=2, keepdims=True), 0, 255)
            want = np.concatenate([np.repeat(eight, 3, axis=2) if colour == 0 else eight, alpha], axis=2)
        assert (got == want).all() and got.dtype == np.uint8


def lzw(numbers, bits):
    """Codes of growing size, begun anew whenever the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    out, have, size = 0, 0, bits + 1
    table, word = {(i,): i for i in range(clear)}, ()

    def put(code):
        nonlocal out, have
        out |= code << have
        have += size

    put(clear)
    for x in numbers:
        if (*word, x) in table:
            word = (*word, x)
            continue
        put(table[word])
        table[(*word, x)] = len(table) + 2
        if len(table) + 2 > 1 << size and size < 12:
            size += 1
        if len(table) + 2 >= 4095:
            put(clear)
            table, size = {(i,): i for i in range(clear)}, bits + 1
        word = (x,)
    put(table[word])
    put(end)
    data = out.to_bytes(-(-have // 8), "little")
    return bytes([bits]) + b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif(width, height, palette, frames):
    """frames: (left, top, numbers, interlaced, disposal, clear, own palette)."""
    bits = max(0, (len(palette) - 1).bit_length() - 1)
    table = lambda p: p.astype(np.uint8).tobytes()
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits, 0, 0) + table(palette)
    for left, top, numbers, interlaced, disposal, clear, own in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 0, 0, clear or 0, 0])
        h, w = numbers.shape
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 | bits if own is not None else 0) | (0x40 if interlaced else 0)) + (table(own) if own is not None else b"")
        order = [y for first, step in pixels.ROWS for y in range(first, h, step)] if interlaced else list(range(h))
        out += lzw(numbers[order].ravel().tolist(), max(2, bits + 1))
    return out + b"\x3b"


def test_gif_frames():
    rng = np.random.default_rng(3)
    palette, own = rng.integers(0, 256, (256, 3)), rng.integers(0, 256, (256, 3))
    a, b, c, d = rng.integers(0, 256, (40, 60)), rng.integers(0, 9, (10, 20)), rng.integers(0, 256, (13, 7)), rng.integers(0, 4, (5, 5))
    data = gif(60, 40, palette, [(0, 0, a, True, 1, None, None), (5, 6, b, False, 3, 4, None), (50, 30, c, True, 2, None, own), (0, 0, d, False, 0, None, None)])
    first = np.concatenate([palette[a], np.full((40, 60, 1), 255)], axis=2)
    second = first.copy()
    second[6:16, 5:25][b != 4] = np.concatenate([palette[b], np.full((10, 20, 1), 255)], axis=2)[b != 4]
    third = first.copy()  # the second frame is taken back
    third[30:40, 50:57] = np.concatenate([own[c[:10]], np.full((10, 7, 1), 255)], axis=2)
    fourth = third.copy()
    fourth[30:40, 50:57] = 0  # the third is cleared
    fourth[:5, :5] = np.concatenate([palette[d], np.full((5, 5, 1), 255)], axis=2)
    for k, want in enumerate((first, second, third, fourth)):
        assert (pixels.decode_gif(data, k) == want).all()
    assert pixels.decode_gif(data, 4) is None and images.header(data) == ("gif", 60, 40, True)
    for cut in range(0, len(data), 37):  # cut files give what they have or nothing
        pixels.decode(data[:cut])


def test_long_lzw_streams():
    rng = np.random.default_rng(9)
    for bits, numbers in ((8, rng.integers(0, 256, 60000)), (2, np.zeros(90000, int)), (3, rng.integers(0, 2, 50000)), (2, np.array([1]))):
        body = lzw(numbers.tolist(), bits)
        data, at = b"", 1
        while body[at]:
            data, at = data + body[at + 1 : at + 1 + body[at]], at + 1 + body[at]
        assert (pixels.unpacked(data, bits, len(numbers)) == numbers).all()


def test_bmp_and_copies_on_white():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-21 % 4) for r in want[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (pixels.decode(bmp)[..., :3] == want).all() and pixels.decode(bmp[:60]) is None
    assert images.white_copy(bmp) is None  # nothing transparent
    sixteen = np.zeros((2, 2, 4), int)
    sixteen[0, 0] = (65535, 0, 0, 65535)
    white = pixels.decode(images.white_copy(make_png(sixteen, 16, 6, 1, rng)))
    assert white[0, 0].tolist() == [255, 0, 0, 255] and (white[1, 1] == 255).all()
    numbers = np.array([[0, 1], [1, 0]])
    white = pixels.decode(images.white_copy(gif(2, 2, np.array([[9, 9, 9], [200, 0, 0]]), [(0, 0, numbers, False, 0, 1, None)])))
    assert white[..., :3].tolist() == [[[9] * 3, [255] * 3], [[255] * 3, [9] * 3]]
    for bad in (b"", b"GIF89a", b"BM", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"):
        assert pixels.decode(bad) is None and images.white_copy(bad) is None
