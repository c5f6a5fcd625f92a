"""Byte-level BPE encoding through a global shuffle of distinct words, and decoding through the token-byte table.

Texts are cut into blocks.  A block's pre-tokens become positions that refer to the block's own distinct words; the
words are dealt out by hash over all blocks, each distinct word is encoded once where it meets its copies (in a large
corpus once for each part of it, which bounds a bucket), and the ids go back to their blocks, where positions put them
in order.  Positions travel as compressed integers, so that the exploded form (text, position, word) never exists as
rows, and a frequent word costs one entry a block.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import pretokens
from .common import estimated_bytes, shuffle_partitions, sub_batches, texts
from .vocabulary import Vocabulary

BLOCK_BYTES = 4 << 20
#: Bytes of input for each bucket of words at least; a bucket holds about a tenth of that in distinct words.
BUCKET_INPUT = 8 << 20
#: Bytes of input whose blocks may meet in one bucket: a word that all blocks have is encoded once for each so many.
SALT_INPUT = 8 << 30
#: Bytes of input for each task of a shuffle, so that none reads more as the input grows.
TASK_INPUT = 16 << 20
_ROW = "bucket int, block long, part int, a binary, b binary, c binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "part", "a", "b", "c"])


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (``id_col`` long, n_tokens long, ids binary: little-endian unsigned 32-bit).

    Null and empty texts have no ids.  Rows keep their number: repeated ids and texts each give a row; a null id stays
    null.  Other columns are ignored.  A text is never cut; one longer than a block is a block.
    """
    spark = ship(df.sparkSession)
    size = estimated_bytes(df)
    size = size if size < 1 << 50 else shuffle_partitions(spark) * BUCKET_INPUT  # unknown
    buckets, salts, tasks = max(shuffle_partitions(spark), min(1 << 22, size // BUCKET_INPUT)), 1 + min(511, size // SALT_INPUT), max(8, size // TASK_INPUT)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def blocks(batches):
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in sub_batches(batch, "text", BLOCK_BYTES):
                own, place = texts(part.column(1)), place + 1
                key = xxhash.xxh64(str((place, part.column(0).to_pylist())).encode())
                key.update("\0".join(own).encode("utf-8", "surrogatepass"))
                yield (key.intdigest() >> 1), part.column(0), own

    def positions(batches):
        for block, ids, own in blocks(batches):
            index, distinct, counts = pretokens.words(own)
            head = pa.RecordBatch.from_arrays([ids, pa.array(counts)], names=["id", "n"])
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), head.schema) as out:
                out.write_batch(head)
            yield _rows([(-1, block, -1, sink.getvalue().to_pybytes(), pack(index), np.int64(len(distinct)).tobytes())])

    def words(batches):
        for block, _, own in blocks(batches):
            mine = pretokens.as_bytes(pretokens.words(own)[1])
            home = np.fromiter((zlib.crc32(w) for w in mine), np.uint32, len(mine)) % buckets
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order].astype(np.int64), prepend=-1)).tolist()
            rows = []
            for i, j in zip(cuts, [*cuts[1:], len(order)], strict=False):
                at = order[i:j]
                held = [mine[k] for k in at.tolist()]
                rows.append((int(home[at[0]]) * salts + block % salts, block, int(home[at[0]]), pack(np.diff(at, prepend=0)), pack(np.fromiter(map(len, held), np.uint32, len(held))), _squeeze(b"".join(held))))
                if len(rows) == 2000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def encode_bucket(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = [unpack(r["b"]) for r in rows]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        data = b"".join(zstandard.ZstdDecompressor().decompress(r["c"]) for r in rows)
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        flat, offsets = pretokens.flat_ids(vocabulary.encode(), pretokens.as_bytes(coded.dictionary))
        index = coded.indices.to_numpy(zero_copy_only=False)
        out, start = [], 0
        for r, n in zip(rows, map(len, sizes), strict=True):
            own = index[start : start + n]
            start += n
            ids, _ = pretokens.gather(flat, offsets, own)
            out.append((r["bucket"], r["block"], r["part"], r["a"], pack((offsets[1:] - offsets[:-1])[own]), pack(ids)))
        return pa.Table.from_batches([_rows(out)])

    def reassemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = [r for r in rows if r["part"] < 0]
        if len(head) != 1:
            raise ValueError(f"block {rows[0]['block']} has {len(head)} position rows")
        known = int(np.frombuffer(head[0]["c"], np.int64)[0])
        sizes, parts, at = np.zeros(known, np.int64), [], []
        for r in rows:
            if r["part"] >= 0:
                own = np.cumsum(unpack(r["a"]).astype(np.int32), dtype=np.int64)
                sizes[own] = unpack(r["b"])
                at.append(own)
                parts.append(unpack(r["c"]))
        if sum(map(len, at)) != known:
            raise ValueError(f"block {rows[0]['block']}: {sum(map(len, at))} of {known} words came back")
        if known:
            # ids come bucket by bucket; offsets say where each word's ids are
            order = np.concatenate(at)
            ends = np.cumsum(sizes[order])
            first = np.empty(known, np.int64)
            first[order] = ends - sizes[order]
            flat = np.concatenate(parts)
            index = unpack(head[0]["b"])
            each = sizes[index]
            token_ends = np.cumsum(each)
            ids = flat[np.repeat(first[index] - (token_ends - each), each) + np.arange(int(token_ends[-1]))]
        else:
            ids, token_ends = np.empty(0, np.uint32), np.empty(0, np.int64)
        docs = pa.ipc.open_stream(head[0]["a"]).read_all()
        matches = np.concatenate([[0], np.cumsum(docs.column("n").to_numpy())])
        tokens = np.concatenate([[0], token_ends])[matches]
        data = ids.astype("<u4", copy=False).tobytes()
        cut = [data[4 * i : 4 * j] for i, j in zip(tokens.tolist(), tokens[1:].tolist(), strict=False)]
        return pa.table({id_col: docs.column("id").cast(pa.int64()), "n_tokens": pa.array(np.diff(tokens), pa.int64()), "ids": pa.array(cut, pa.binary())})

    encoded = source.mapInArrow(words, _ROW).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(encode_bucket, _ROW)
    return source.mapInArrow(positions, _ROW).unionAll(encoded).repartition(tasks, "block").groupBy("block").applyInArrow(reassemble, f"`{id_col}` long, n_tokens long, ids binary")


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes of every row's ids: columns ``keep``, ``ids_col`` and ``out_col`` (binary); null ids give empty bytes.

    An id outside the vocabulary raises.  A clashing ``out_col`` is replaced.
    """
    from .common import map_arrow

    names = [c for c in dict.fromkeys((*keep, ids_col)) if c != out_col]
    source = df.select(*names)

    def fn(batch: pa.RecordBatch) -> dict:
        flat, offsets = vocabulary.token_bytes()
        out = []
        for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist():
            index = np.frombuffer(ids or b"", "<u4")
            pieces = [pretokens.gather(flat, offsets, index[i : i + 2_000_000])[0].tobytes() for i in range(0, len(index), 2_000_000)]
            out.append(pieces[0] if len(pieces) == 1 else b"".join(pieces))
        return {n: batch.column(i) for i, n in enumerate(names)} | {out_col: pa.array(out, pa.binary())}

    from pyspark.sql.types import BinaryType, StructType

    return map_arrow(source, StructType([*source.schema.fields]).add(out_col, BinaryType()), fn)
