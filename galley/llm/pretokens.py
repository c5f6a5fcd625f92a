"""Vectorised pre-tokeniser and word encoder for byte-level BPE vocabularies.

``public_tokenizers.PATTERN`` splits a text into contractions, letter runs, number runs, other runs (each with one
leading blank) and white space.  All its matches tile the text, so a batch is split by marking start positions in an
array of code points, and the matches of a batch are an Arrow array over the same buffer, which Arrow's dictionary
encoding reduces to its distinct words without making a Python string for each match.
"""
from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: White_Space code points of Unicode (fixed values).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as the pattern's ``\\p{L}``, ``\\p{N}`` and ``\\s`` see it."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), "S1")
    out[kinds == b"L"], out[kinds == b"N"] = LETTER, NUMBER
    out[list(WHITE)] = SPACE
    return out


def starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a match begins. codes: code points of texts one after another; first: offsets of the (non-empty) texts."""
    n = len(codes)
    kind = classes()[codes]
    new = np.zeros(n, bool)  # a text begins
    new[first] = True
    ends = np.zeros(n, bool)  # a text ends
    ends[:-1], ends[-1] = new[1:], True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | new[1:]
    space = kind == SPACE
    after_blank = np.zeros(n, bool)  # a blank stands before, in the same text
    after_blank[1:] = (codes[:-1] == 32) & ~new[1:]
    before_word = np.zeros(n, bool)  # the last white space before something else
    before_word[:-1] = space[:-1] & ~space[1:] & ~ends[:-1]
    out = (change & ~space & ~after_blank) | (space & (change | before_word))

    quote = np.flatnonzero((codes == 39) & change & ~after_blank & ~ends)
    if len(quote):
        far = np.append(codes, [0, 0])
        one, two = far[quote + 1], far[quote + 2]
        two = np.where(ends[quote + 1], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 1), (quote[long], 2)):
            out[at + 1] = False
            after = at + 1 + size
            out[after[after < n]] = True  # what follows the contraction begins a match, were it a letter of the same run
    return out


def words(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(index of each match into the distinct words, the distinct words in UTF-8, number of matches of each text)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    if not joined:
        return np.empty(0, np.int32), pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(sizes) - sizes
    begin = np.flatnonzero(starts(codes, at[sizes > 0]))
    data = joined.encode("utf-8", "surrogatepass")
    offsets = np.append(begin, len(codes))
    if len(data) != len(codes):  # code points to bytes: what the wide ones before add
        wide = np.flatnonzero(codes >= 0x80)
        more = 1 + (codes[wide] >= 0x800).astype(np.int64) + (codes[wide] >= 0x10000)
        offsets = offsets + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(wide, offsets)]
    matches = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = matches.dictionary_encode()
    counts = np.searchsorted(begin, at + sizes) - np.searchsorted(begin, at)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), coded.dictionary, counts


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls, cut out of its buffer."""
    if not len(column):
        return []
    column = column.cast(pa.large_binary())
    data = column.buffers()[2].to_pybytes() if column.buffers()[2] else b""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def ranks_of_tiktoken(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.splitlines()))}


def ranks_of_json(data: bytes) -> dict[bytes, int]:
    """Ranks of a byte-level BPE ``tokenizer.json``: valid where merges are numbered in order, which is checked."""
    model = json.loads(data)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError("the vocabulary's ids don't follow the order of its merges")
    whole = {w: i for w, i in model["vocab"].items() if all(c in byte for c in w) and not (w.startswith("<|") and w.endswith("|>"))}
    return {bytes(byte[c] for c in w): i for w, i in whole.items()}


def encoder(ranks: dict[bytes, int]):
    """A function from the bytes of one match to its ids."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("galley", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def flat_ids(encode, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct words one after another, offsets with one more entry than words)."""
    out = [encode(w) for w in distinct]
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    ids = np.fromiter((i for w in out for i in w), np.uint32, int(sizes.sum()))
    return ids, np.concatenate([[0], np.cumsum(sizes)])


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the slices ``flat[offsets[i]:offsets[i + 1]]`` for each i of ``index`` one after another, their ends)."""
    sizes = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(offsets[:-1][index] - (ends - sizes), sizes) + np.arange(total)
    return flat[at], ends
