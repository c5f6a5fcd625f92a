"""Periodic runs of words by the longest previous factor, and texts without what a run repeats.

A text is a sequence of word numbers.  Its suffix array comes from prefix doubling, whose ranks of all powers of two are
kept: with them the longest common extension of two places, to either side, is a descent over the powers.  Neighbours in the
suffix array with their common prefixes give the longest previous factor of each place, and that gives the blocks of a
Lempel-Ziv parse.  A run of exponent three or more that touches the start of a block is an extension about it (Main); one
that lies within a block is a copy of an earlier run and is taken from the bucket of that one's start.

A run of ``least`` words and exponent ``exponent`` repeats ``least - least // exponent`` words, so a text whose places all
differ within so many words has no run, which the first powers of two tell; only other texts are sorted to the end.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from .common import sub_batches, texts, tidied

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def powers_of_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... numbers from each place, cut at the end, until all differ; the last sorts suffixes."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    out, step = [rank], 1
    while n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32)
        out.append(rank)
        step *= 2
    return out


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many numbers agree from places a and b on, or before them; a and b must differ."""
    n, a, b = len(ranks[0]), a.astype(np.int64), b.astype(np.int64)
    got = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        room = (np.minimum(a, b) >= got + step) if back else (np.maximum(a, b) + got + step <= n)
        at = np.flatnonzero(room)
        if len(at):
            x, y = (a[at] - got[at] - step, b[at] - got[at] - step) if back else (a[at] + got[at], b[at] + got[at])
            same = ranks[k][x] == ranks[k][y]
            got[at[same]] += step
    return got


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the longest stretch that also starts earlier, and where; suffixes in order, lcp[i] that of i - 1 and i."""
    n = len(suffixes)
    size, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (place, common prefix with the one below it), places ascending
    for place, shared in zip([*suffixes.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while stack and stack[-1][0] > place:  # the one on top has both its smaller neighbours now
            own, below = stack.pop()
            if below > shared:
                size[own], source[own] = below, stack[-1][0]
            elif shared:
                size[own], source[own] = shared, place
            shared = min(shared, below)
        stack.append((place, shared if stack else 0))
    return size, source


def blocks(size: list[int], source: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of the parse, and of their earlier occurrences (-1: a number not seen before)."""
    starts, froms, at = [], [], 0
    while at < len(size):
        starts.append(at)
        froms.append(source[at])
        at += max(size[at], 1)
    return np.array(starts, np.int64), np.array(froms, np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i as many rows as counts[i]: i, and 1, 2, ... within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def _about_starts(ranks: list[np.ndarray], starts: np.ndarray, least: int, exponent: int) -> set[tuple[int, int, int]]:
    """Runs (start, end, period) that touch a block's start.

    Take such a run and the first start of a block at least a period after the run's own.  If it is within the run, a whole
    period lies before it, and fewer than the last block's numbers before that period, or else that block would have been
    longer; and the block that starts here reaches the run's end.  If there is none, the block that the run's second period
    starts in holds the rest of it.
    """
    n = len(ranks[0])
    starts = np.append(starts, n)  # an empty block for what reaches the end
    sizes = np.diff(np.append(starts, n))
    before = np.concatenate([[0], sizes[:-1]])
    found = set()
    for left in (True, False):
        span = before + sizes if left else sizes
        most = np.maximum(np.minimum(span // (exponent - 1), starts if left else n - starts - 1), 0)
        most[span * exponent < least * (exponent - 1)] = 0  # the run has at most a period more than the span
        for part in np.array_split(np.arange(len(starts)), max(1, int(most.sum()) >> 20)):
            owner, period = _spread(most[part])
            at = starts[part][owner]
            other = at - period if left else at + period
            ahead, behind = common(ranks, at, other), common(ranks, at, other, back=True)
            begin, end = np.minimum(at, other) - behind, np.maximum(at, other) + ahead
            good = (end - begin >= least) & (end - begin >= exponent * period)
            found.update(zip(begin[good].tolist(), end[good].tolist(), period[good].tolist(), strict=True))
    return found


def runs(ids: np.ndarray, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``least`` numbers and ``exponent`` (3 or more) periods, in order."""
    n = len(ids)
    if n < least:
        return []
    ranks = powers_of_ranks(ids)
    suffixes = np.argsort(ranks[-1])
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common(ranks, suffixes[1:], suffixes[:-1])
    if int(lcp.max()) < least - least // exponent:
        return []
    starts, froms = blocks(*previous_factors(suffixes, lcp))
    buckets: dict[int, set[tuple[int, int]]] = {}
    for begin, end, period in _about_starts(ranks, starts, least, exponent):
        buckets.setdefault(begin, set()).add((end, period))
    for start, end, source in zip(starts.tolist(), [*starts[1:].tolist(), n], froms.tolist(), strict=True):
        if source >= 0 and end - start > least and buckets:
            shift = start - source
            for begin in range(source + 1, end - shift - least):  # runs copied here may be copied again
                for stop, period in tuple(buckets.get(begin, ())):
                    if stop + shift < end:
                        buckets.setdefault(begin + shift, set()).add((stop + shift, period))
    smallest: dict[tuple[int, int], int] = {}
    for begin, held in buckets.items():
        for end, period in held:
            smallest[begin, end] = min(period, smallest.get((begin, end), period))
    return sorted((begin, end - begin, period) for (begin, end), period in smallest.items())


def suspects(documents: list[list[str]], least: int, exponent: int) -> np.ndarray:
    """Which documents have a stretch of the power of two up to ``least - least // exponent`` words twice: all that may have a run."""
    counts = np.array([len(w) for w in documents], np.int64)
    out = np.zeros(len(documents), bool)
    number: dict[str, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for words in documents for w in words), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(documents)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    rank = flat + owner * np.int64(len(number) + 1)  # no stretch is equal to one of another document
    live, step = np.arange(len(flat)), 1
    while len(live):
        _, inverse, times = np.unique(rank[live], return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        live = live[again]
        if 2 * step > least - least // exponent:
            out[owner[live]] = True
            break
        named = np.full(len(flat), -1, np.int64)
        named[live] = inverse[again]
        live = live[live + 2 * step <= ends[live]]
        live = live[named[live + step] >= 0]  # a stretch twice has its second half twice
        rank = np.zeros(len(flat), np.int64)
        rank[live] = named[live] * np.int64(len(flat) + 1) + named[live + step]
        step *= 2
    return out


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: of each run its first period stays, unless another one drops it."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    dropped = np.cumsum(edge)[:-1] > 0
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """One row per input row: (doc_id, n_words, runs, collapsed).

    Words are stretches of anything but the six ASCII white space characters.  ``runs`` has (start, length, period) of every
    run by start, then period; ``collapsed`` is the text without the words that runs repeat, joined by single spaces.  Null and
    empty texts have no word and collapse to an empty text; rows keep their number, identifiers may be null or repeated;
    an empty table gives no row; other columns are ignored.  A text has to fit a task, with some hundred bytes a word.
    """
    if exponent < 3 or least < exponent:
        raise ValueError("runs have three periods or more")
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    schema = StructType([source.schema.fields[0]]).add("n_words", "long").add("runs", StructType.fromDDL("r array<struct<start: long, length: long, period: long>>")[0].dataType).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "__text"):
                held = [WORD.findall(t) for t in texts(part.column(1))]
                found: list[list[tuple[int, int, int]]] = [[] for _ in held]
                for k in np.flatnonzero(suspects(held, least, exponent)).tolist():
                    number: dict[str, int] = {}
                    found[k] = runs(np.fromiter((number.setdefault(w, len(number)) for w in held[k]), np.int64, len(held[k])), least, exponent)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                left = [" ".join(collapse(w, f)) for w, f in zip(held, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in held], pa.int64()), pa.array(rows, kind), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), schema)
