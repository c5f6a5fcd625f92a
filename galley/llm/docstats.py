"""Statistics of whole texts, as counts: what the quality rules and the quality classifier work on."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sub_batches, texts, tidied

SYMBOLS = "#*$%&|<>"
NAMES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_stops", "longest", "most_frequent", "sum_squares", "n_wide")
_WHITE = " \t\n\x0b\x0c\r"


def repeat_words(ids: np.ndarray, window: int = 3) -> int:
    """Words in windows found twice or more, the first included. ids: numbers of the words, from 0."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, most = ids[:n].astype(np.int64), int(ids.max()) + 1
    for k in range(1, window):
        if (int(key.max()) + 1) * most >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * most + ids[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[hit + k] = True
    return int(covered.sum())


def stats(text: str) -> tuple[int, ...]:
    """The counts of ``NAMES``. Words are runs of anything but the six ASCII white space characters."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (
        len(text), len(words), len(text) - int(byte[[ord(c) for c in _WHITE]].sum()), int(byte[[ord(c) for c in SYMBOLS]].sum()), len(lines), len(lines) - len(set(lines)), len(number), repeat_words(ids),
        int(byte[65:91].sum()), int(byte[48:58].sum()), int(byte[33] + byte[63]), int(byte[46] + byte[44] + byte[59] + byte[58]), int(sizes.max(initial=0)), int(np.bincount(ids).max(initial=0)) if len(ids) else 0, int((sizes * sizes).sum()), int(byte[192:].sum()),
    )


def with_stats(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the counts of ``NAMES`` (long) of every text; null counts as empty."""
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*source.schema.fields[:-1]])
    for n in NAMES:
        schema.add(n, LongType())

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "__text"):
                made = np.array([stats(t) for t in texts(part.column(len(keep)))], np.int64).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=[*keep, *NAMES])

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), schema)
