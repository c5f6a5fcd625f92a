"""Near-duplicate detection: SimHash fingerprints, linked through sharded BK-trees.

Two fingerprints that differ in at most r bits agree on the bits of some ``blocks - r`` of ``blocks`` blocks, so each
fingerprint goes to one shard for every choice of such blocks, and every link lies within a shard.  The number of
blocks follows the number of fingerprints, which keeps shards small.  A shard's distinct fingerprints form BK-trees of
at most ``TREE`` nodes, in which children are keyed by their integer Hamming distance to the parent; all fingerprints
of the shard are searched in each of its trees along edges within the radius.  A shard with more than ``TREE``
fingerprints has its trees sent to as many tasks as it has pairs of blocks of queries and trees, so no task holds more
than one tree and one block.  All trees together grow with the corpus; so a tree travels to the tasks that hold its
queries rather than to every executor.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from .common import by_group, materialize, shuffle_partitions, sub_batches, texts, tidied, tree_sum
from .components import connected_components

BITS, TREE = 64, 4096


def shingles(text: str, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text in order, repeats included; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    data, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= ngram:
        return np.array([h(data, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    cut = zip(begins[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist(), strict=True)
    return np.fromiter((h(data[i:j], 42) for i, j in cut), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, ngram: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is 1 if set in over half the hashes."""
    return majority(shingles(text, ngram))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer; null and empty texts have 0."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text", 16 << 20):
                found = np.array([fingerprint(t, ngram) for t in texts(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), "doc_id long, fp long")


class BKTree:
    """A tree of distinct 64-bit values, stored as arrays; node 0 is the root."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:  # what is left of a subtree falls into one child for each distance to its root
            own = todo.pop()
            root, rest = own[0], own[1:]
            if len(rest):
                apart = np.bitwise_count(values[rest] ^ values[root])
                order = np.argsort(apart, kind="stable")
                cuts = np.flatnonzero(np.diff(apart[order], prepend=-1)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(rest)], strict=True):
                    child = rest[order[i:j]]
                    self.children[root][int(apart[order[i]])] = int(child[0])
                    todo.append(child)

    def search(self, queries: np.ndarray, radius: int):
        """Yields (node, indices of the queries within the radius of it); an edge is followed if its key is within the radius of the query's distance."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, own = todo.pop()
            apart = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int16)
            near = own[apart <= radius]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                follow = own[np.abs(apart - key) <= radius]
                if len(follow):
                    todo.append((child, follow))


def _small(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a few values, through a BK-tree that grows by insertion."""
    out, tree = [], []
    for n, x in enumerate(values):
        todo = [0] if tree else []
        while todo:
            at = todo.pop()
            apart = (values[at] ^ x).bit_count()
            if apart <= radius:
                out.append((at, n))
            todo += [c for key, c in tree[at].items() if abs(key - apart) <= radius]
        at = 0
        while n:  # where it belongs
            apart = (values[at] ^ x).bit_count()
            if apart not in tree[at]:
                tree[at][apart] = n
                break
            at = tree[at][apart]
        tree.append({})
    return out


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the links: pairs yields (node, linked nodes)."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, others in pairs:
        for b in others:
            x, y = root(a), root(b)
            if x != y:
                parent[y] = x
                out.append((a, b))
    return out


def shard_links(fp: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Enough links (indices) to connect what the trees of one shard and its queries connect."""
    if len(fp) <= 24 and is_tree.all():
        return _forest(len(fp), ((a, (b,)) for a, b in _small(fp.tolist(), radius)))
    nodes, asked = np.flatnonzero(is_tree), np.flatnonzero(is_query)
    tree = BKTree(fp[nodes])
    return _forest(len(fp), ((int(nodes[node]), asked[near].tolist()) for node, near in tree.search(fp[asked], radius)))


def masks(n: int, radius: int) -> list[int]:
    """The bits of each table's keys: enough blocks that a table has about one fingerprint a key, at most 2 * radius."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n <= 64 << (BITS * (blocks - radius) // blocks):
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def links(distinct: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect all those within the radius of each other."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(n, radius)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("tbl", "key"))
    dealt = _deal(keyed.withColumnRenamed("fp", "id"), TREE)

    def work(part):
        us, vs = [], []
        for i, j in _cuts(part[:4]):
            own, fp = part[4][i:j], part[5][i:j]
            for x, y in shard_links(fp.view(np.uint64), own == part[2][i], own == part[3][i], radius):
                us.append(int(fp[x]))
                vs.append(int(fp[y]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return _by_shard(dealt, work, "u long, v long")


_SHARD = ("tbl", "key", "t", "q")


def _cuts(key: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where groups of adjacent equal keys begin and end; groups of one are left out."""
    new = np.logical_or.reduce([np.diff(k, prepend=k[:1] - 1) != 0 for k in key])
    at = np.append(np.flatnonzero(new), len(new))
    return [(i, j) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False) if j - i > 1]


def _by_shard(dealt: DataFrame, work, schema: str) -> DataFrame:
    """Apply work(columns) to runs of whole shards (tbl, key, t, q), whose rows are brought together and streamed."""

    def run(batches):
        held = None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            same = np.logical_and.reduce([c == c[-1] for c in part[:4]])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield work([c[:whole] for c in part])
            held = [c[whole:] for c in part]
        if held is not None and len(held[0]):
            yield work(held)

    ship(dealt.sparkSession)
    placed = dealt.repartition(shuffle_partitions(dealt.sparkSession), *_SHARD).sortWithinPartitions(*_SHARD)
    return placed.mapInArrow(tidied(run), schema)


def _deal(keyed: DataFrame, most: int) -> DataFrame:
    """(tbl, key, t, q, own, ...) of rows (tbl, key, id, ...): those of a key with over ``most`` rows meet in pairs of trees.

    A row is a node of tree ``own`` and a query of it and the trees before it; it goes to each pair it has a part in.
    """
    large = keyed.groupBy("tbl", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tbl", "key", F.ceil(F.col("n") / most).cast("int").alias("trees"))
    cut = keyed.join(large, ["tbl", "key"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("trees")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("t"), F.greatest(x, F.col("own")).alias("q")))
    rest = [c for c in keyed.columns if c not in ("tbl", "key")]
    return cut.withColumn("p", F.explode(pairs)).select("tbl", "key", "p.t", "p.q", "own", *rest)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id, n_same).

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest identifier reachable over links of at most
    ``radius`` bits, ``n_same`` how many rows have the same fingerprint.  Null and empty texts have fingerprint zero and
    are linked like any other.  Rows keep their number, also with repeated identifiers; a null identifier is never a
    component's smallest unless the component has no other.  An empty table gives no row; other columns are ignored.
    """
    found = materialize(fingerprints(df, id_col, text_col, ngram), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")), "distinct")
    labels = connected_components(links(distinct.select("fp"), distinct.count(), radius))
    labelled = materialize(labels.select(F.col("v").alias("fp"), "label").join(distinct.select("fp", "first"), "fp"), "labels")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(smallest, "label").select("fp", "component_id")
    full = distinct.join(by_fp, "fp", "left").select("fp", "n_same", F.coalesce("component_id", "first").alias("component_id"), F.col("n_same").alias("__n"))
    return by_group(found, materialize(full, "full"), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


BLOCK, BLOCK_BYTES, MANY, FEW_SETS, DENSE = 1024, 32 << 20, 100_000, 200_000, 8
#: Counters of shingles, as bits: at least and at most (64 MB), and how many shingles there may be for each before there are more.
LEAST_BITS, MOST_BITS, FULL = 20, 24, 1000


def sketch(members: np.ndarray) -> bytes:
    """How many members of a set of 32-bit hashes each of 2 ** k equal ranges has, about six; nothing where one has over 255."""
    if not len(members):
        return b""
    bits = max(2, math.ceil(math.log2(len(members) / 8)))
    counts = np.bincount(members >> np.uint32(32 - bits), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int, similarity: float) -> bool:
    """Whether sets of these sketches and sizes can have this similarity: they share no more than their ranges allow."""
    if n_a < similarity * n_b - 1e-9 or n_b < similarity * n_a - 1e-9:
        return False
    if not a or not b:
        return True
    x, y = sorted((np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)), key=len)
    both = int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())
    return both * (1 + similarity) >= similarity * (n_a + n_b) - 1e-9


def _sets(df: DataFrame, id_col: str, text_col: str, ngram: int, carry: tuple[str, ...]) -> DataFrame:
    """(doc_id, id, fp, n, sketch, shingles, *carry) of every text: id is a hash of the set of its n shingles, shingles their sorted 32-bit hashes."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    names = ["doc_id", "id", "fp", "n", "sketch", "shingles", *carry]
    schema = StructType.fromDDL("doc_id long, id long, fp long, n int, sketch binary, shingles binary")
    for field in source.schema.fields[2:]:
        schema.add(field)

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text", 8 << 20):
                cols: list[list] = [[] for _ in range(5)]
                for t in texts(part.column(1)):
                    own = np.unique(shingles(t, ngram))
                    small = np.unique(own.astype(np.uint32))
                    for c, v in zip(cols, (xxhash.xxh64_intdigest(data := small.tobytes(), 1), majority(own), len(small), sketch(small), data), strict=True):
                        c.append(v)
                signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
                yield pa.RecordBatch.from_arrays([part.column(0), *signed, pa.array(cols[2], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[3:]), *part.columns[2:]], names=names)

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), schema)


def _counter_bits(n_shingles: int) -> int:
    """Bits of the number of counters for so many shingles, so that what few sets have isn't taken for frequent in a large corpus."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n_shingles, 1) / FULL))))


def _shingle_counts(sets: DataFrame, n_shingles: int) -> np.ndarray:
    """How many shingles of all sets fall to each counter: the leading bits of a shingle's hash say to which."""
    bits = _counter_bits(n_shingles)

    def part(batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
        return [np.bincount(flat >> np.uint32(32 - bits), minlength=1 << bits)]

    found = tree_sum(sets.select("shingles"), part)
    return found[0] if found else np.zeros(1 << bits)


def _prefix_length(n: int, similarity: float) -> int:
    """Two sets this similar have one of their first so many members in common, whatever the order, if it is one for all sets."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(key, salt, salts, id): the members of each set's prefix, those with the least counts first.

    A member whose counter says that it may be in over ``MANY`` sets, and in far more than an average one, is dealt out by salt.
    """
    known = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.uint32))  # 2^MOST_BITS numbers at most
    unused, most = np.uint32(32 - (len(counts).bit_length() - 1)), max(MANY, 8 * int(counts.mean()), 1)

    def run(batches):
        count, seen = known.value, set()
        for batch in batches:
            keys, salts, ids = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_py(), np.uint32)
                k = _prefix_length(len(own), similarity)
                if not k or i in seen:
                    continue
                seen.add(i)
                order = count[own >> unused].astype(np.uint64) << np.uint64(32) | own
                first = np.partition(order, k - 1)[:k]
                keys.append(first.astype(np.uint32))
                salts.append((first >> np.uint64(32)).astype(np.int64) // most + 1)
                ids.append(np.full(k, i))
            if keys:
                many, own = np.concatenate(salts), np.concatenate(ids)
                salt = (own.view(np.uint64) % many.view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int32)), pa.array(salt), pa.array(many.astype(np.int32)), pa.array(own)], names=["key", "salt", "salts", "id"])

    ship(sets.sparkSession)
    return sets.select("id", "shingles").mapInArrow(tidied(run), "key int, salt int, salts int, id long")


def _stars(prefixes: DataFrame) -> DataFrame:
    """(key, salts, u, v, pair): every set v with a key, beside the first set u of the key (and salt); keys of one set are left out, if not salted.

    ``pair`` says that the key is known to have two sets only; that of some with two isn't known.
    """

    def run(batches):
        last = None  # key, salt, first set, set before, whether the first set has been written
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, salt, salts, ids = (c.to_numpy() for c in batch.columns)
            new, same = np.ones(n, bool), np.zeros(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            same[1:] = ~new[1:] & (ids[1:] == ids[:-1])
            if last is not None and (key[0], salt[0]) == last[:2]:
                new[0], same[0] = False, ids[0] == last[3]
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first = np.where(at >= 0, ids[at], last[2] if last is not None else 0)
            member = ~new & ~same
            heads = np.unique(np.concatenate([at[member], np.flatnonzero(new & (salts > 1))]))
            carried = len(heads) > 0 and heads[0] < 0
            heads = heads[heads >= 0]
            early = [[x] for x in (last[0], salts[0], last[2], last[2])] if carried and not last[4] else [[]] * 4
            cols = [np.concatenate([np.array(e, k.dtype), a[heads], b[member]]) for e, k, a, b in zip(early, (key, salts, ids, ids), (key, salts, ids, ids), (key, salts, first, ids), strict=True)]
            group = np.cumsum(new)
            pair = (np.bincount(group[member], minlength=group[-1] + 1) == 1) & (np.arange(group[-1] + 1) > 0) & (np.arange(group[-1] + 1) < group[-1])
            cols.append(np.concatenate([np.zeros(len(early[0]), bool), pair[group[heads]] & (salts[heads] == 1), pair[group[member]] & (salts[member] == 1)]))
            written = bool(len(heads) and heads[-1] == at[-1]) if at[-1] >= 0 else carried or last[4]
            last = key[-1], salt[-1], first[-1], ids[-1], written
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "salts", "u", "v", "pair"])

    ship(prefixes.sparkSession)
    by = ["key", "salt", "id"]
    return prefixes.repartition(shuffle_partitions(prefixes.sparkSession), "key", "salt").sortWithinPartitions(*by).mapInArrow(tidied(run), "key int, salts int, u long, v long, pair boolean")


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of sorted arrays of distinct numbers."""
    if not (len(a) >= similarity * len(b) - 1e-9 and len(b) >= similarity * len(a) - 1e-9):
        return False
    small, large = sorted((a, b), key=len)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return both * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-9


def similar_links(sets: list[bytes], nodes: np.ndarray, asked: np.ndarray, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (node, asked) with at least this Jaccard similarity, over what roots (a label each) have linked."""
    members = [np.frombuffer(x, np.uint32) for x in sets]
    sizes = np.array([len(m) for m in members])
    flat = np.unique(np.concatenate(members), return_inverse=True)[1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    root = np.unique(roots, return_inverse=True)[1]
    out = []
    for node in nodes.tolist():
        near = asked[root[asked] != root[node]]
        near = near[(sizes[near] >= similarity * sizes[node] - 1e-9) & (sizes[node] >= similarity * sizes[near] - 1e-9)]
        if not len(near):
            continue
        mark[flat[offsets[node] : offsets[node + 1]]] = True
        ends = np.cumsum(sizes[near])
        at = np.repeat(offsets[:-1][near] - (ends - sizes[near]), sizes[near]) + np.arange(int(ends[-1]))
        both = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - sizes[near])
        mark[flat[offsets[node] : offsets[node + 1]]] = False
        for q in near[both * (1 + similarity) >= similarity * (sizes[near] + sizes[node]) - 1e-9].tolist():
            if root[node] != root[q]:
                root[root == root[q]] = root[node]
                out.append((node, q))
    return out


def _proposed(distinct: DataFrame, stars: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) of sets that may be similar: by fingerprints, through BK-trees, and by shared keys."""
    fps = materialize(distinct.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("__n")), "fps")
    same = by_group(distinct.select("id", "fp"), fps, ["fp"]).where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    head = lambda c: fps.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    trees = links(fps.select("fp"), fps.count(), radius).join(head("u"), "u").join(head("v"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    firsts = stars.where("salts > 1 and u = v").select("key", "v")
    hot = firsts.join(firsts.groupBy("key").agg(F.min("v").alias("u")), "key").select("u", "v")
    pairs = stars.select("u", "v").union(hot).union(trees).union(same).where("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _attached(pairs: DataFrame, table: DataFrame, columns: list[str], few: int | None = None) -> DataFrame:
    """Pairs (u, v) with the columns of both their sets, as u_name and v_name; a set with many pairs is joined apart."""
    side = lambda x: table.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    heads = materialize(pairs.groupBy("u").agg(F.count("*").alias("__n")).join(side("u"), "u"), "heads")
    return by_group(pairs.join(side("v"), "v"), heads, ["u"], most=100, few=few)


def _kept(rows: DataFrame, names: list[str], test) -> DataFrame:
    """The pairs (u, v) of rows whose values of the columns pass a test."""

    def run(batches):
        for batch in batches:
            keep = [test(*(x.as_py() for x in row)) for row in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["u", "v"])

    ship(rows.sparkSession)
    return rows.select("u", "v", *names).mapInArrow(tidied(run), "u long, v long")


def _candidates(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches and sizes don't rule the similarity out."""
    rows = _attached(pairs, distinct, ["n", "sketch"])
    return _kept(rows, ["u_sketch", "v_sketch", "u_n", "v_n"], lambda a, b, m, n: may_be_similar(a, b, m, n, similarity))


def _shingles_of(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the sets named; up to ``FEW_SETS`` identifiers are broadcast, so that other sets stay where they are."""
    wanted = materialize(ids.distinct(), "ids")
    few = wanted.count() <= FEW_SETS
    return materialize(found.select("id", "shingles").join(F.broadcast(wanted) if few else wanted, "id", "left_semi").groupBy("id").agg(F.min("shingles").alias("shingles")), "wanted")


def _verified(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs that have the similarity."""
    sets = _shingles_of(found, pairs.select(F.explode(F.array("u", "v")).alias("id")))
    as_set = lambda x: np.frombuffer(x, np.uint32)
    return _kept(_attached(pairs, sets, ["shingles"], few=0), ["u_shingles", "v_shingles"], lambda a, b: jaccard_at_least(as_set(a), as_set(b), similarity))


def _completed(stars: DataFrame, labels: DataFrame, distinct: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links between labels (u, v) that are missing: from keys whose sets have several labels, all pairs of which are compared.

    Keys with the same sets are one.  A key's most frequent label is left out of one side, so that a few others beside a
    large component meet its blocks, and its blocks don't meet each other.  Sketches are compared first; only sets that
    have a partner by these are brought together.  The two sets of a key that has no others have been compared before.
    """
    owned = stars.where("not pair").select("key", F.col("v").alias("id")).distinct().join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    owned = materialize(owned, "owned")
    mark = F.xxhash64("id")
    by_label = owned.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("a"), F.sum(mark.bitwiseAND(F.lit((1 << 32) - 1))).alias("b"))
    mixed = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b")).where("labels > 1 and n > 2")
    mixed = mixed.groupBy("a", "b", "n").agg(F.min(F.struct("key", F.col("top.label").alias("top"), F.col("top.n").alias("n_top"))).alias("m")).select("m.*", (F.col("n") - F.col("m.n_top")).alias("n_rest"))
    rows = by_group(owned, materialize(mixed.withColumn("__n", F.col("n_rest") + F.col("n_top")), "mixed"), ["key"])
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    is_top = F.col("label") == F.col("top")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), F.when(is_top, blocks("n_top")).otherwise(blocks("n_rest"))).cast("int") - F.when(is_top, blocks("n_top")).otherwise(0))
    trees = F.sequence(F.lit(0), blocks("n_rest") - 1)
    small = F.sequence(-blocks("n_top"), F.lit(-1))  # blocks of the most frequent label have numbers below zero
    meets = F.when(is_top, F.transform(trees, lambda t: F.struct(t.alias("t"), F.col("own").alias("q")))).otherwise(
        F.concat(F.transform(small, lambda q: F.struct(F.col("own").alias("t"), q.alias("q"))), F.transform(trees, lambda t: F.struct(F.least(t, F.col("own")).alias("t"), F.greatest(t, F.col("own")).alias("q"))))
    )
    dealt = rows.withColumn("p", F.explode(meets)).select(F.lit(0).alias("tbl"), "key", "p.t", "p.q", "own", "id", "label")
    kept = ["tbl", "key", "t", "q", "own", "id", "label"]

    def rule_out(part):
        """Pairs (id, other) that may be similar; of a shard with many of them the rows that are in one, other being null."""
        rows, others = [], []
        for i, j in _cuts(part[:4]):
            own = part[4][i:j]
            nodes, asked = np.flatnonzero(own == part[2][i]), np.flatnonzero(own == part[3][i])
            a, b = _partners(part[8][i:j], part[7][i:j], part[6][i:j], nodes, asked, similarity)
            involved = np.unique(np.concatenate([a, b]))
            if len(a) > DENSE * len(involved):
                rows.append(i + involved)
                others.append(np.zeros(len(involved), np.int64) - 1)
            else:
                rows.append(i + a)
                others.append(i + b)
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        other = np.concatenate(others) if others else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in part[:7]), pa.array(part[5][other], mask=other < 0)], names=[*kept, "other"])

    schema = "tbl int, key int, t int, q int, own int, id long, label long, other long"
    hits = materialize(_by_shard(dealt.join(distinct.select("id", "n", "sketch"), "id").select(*kept, "n", "sketch"), rule_out, schema), "hits")

    def compare(part):
        us, vs = [], []
        for i, j in _cuts(part[:4]):
            own, label = part[4][i:j], part[5][i:j]
            nodes, asked = np.flatnonzero(own == part[2][i]), np.flatnonzero(own == part[3][i])
            sized = np.array([len(x) for x in part[6][i:j]])
            for a in _byte_cuts(nodes, sized):  # very long texts meet in smaller parts
                for b in _byte_cuts(asked, sized):
                    at = np.unique(np.concatenate([a, b]))
                    for x, y in similar_links([part[6][i + k] for k in at.tolist()], np.searchsorted(at, a), np.searchsorted(at, b), label[at], similarity):
                        us.append(int(label[at[x]]))
                        vs.append(int(label[at[y]]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    alone = hits.where("other is not null").select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
    linked = materialize(_verified(materialize(alone, "alone"), found, similarity), "linked")
    labelled = distinct.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    ends = lambda c: labelled.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    linked = linked.join(ends("u"), "u").join(ends("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    dense = materialize(hits.where("other is null").drop("other"), "dense")
    sets = _shingles_of(found, dense.select("id"))
    return linked.union(_by_shard(dense.join(sets, "id").select("tbl", "key", "t", "q", "own", "label", "shingles"), compare, "u long, v long"))


def _partners(sketches: np.ndarray, sizes: np.ndarray, label: np.ndarray, nodes: np.ndarray, asked: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, asked), as two arrays of indices, that may be similar and have different labels."""
    wide = {}  # for each width of sketches those asked, as rows of a matrix, also at half the width
    width = np.array([len(x) for x in sketches])
    for w in np.unique(width[asked]).tolist():
        own = asked[width[asked] == w]
        matrix = np.frombuffer(b"".join(sketches[own]), np.uint8).reshape(len(own), w)
        wide[w] = own, matrix, matrix.reshape(len(own), -1, 2).sum(2, dtype=np.uint16) if w > 1 else matrix
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for node in nodes.tolist():
        mine, w = np.frombuffer(sketches[node], np.uint8), int(width[node])
        for v, (own, matrix, half) in wide.items():
            near = (label[own] != label[node]) & (sizes[own] >= similarity * sizes[node] - 1e-9) & (sizes[node] >= similarity * sizes[own] - 1e-9)
            if not near.any():
                continue
            if v and w and v in (w, 2 * w, w // 2):
                a, b = (matrix[near], mine) if v == w else (half[near], mine) if v == 2 * w else (matrix[near], mine.reshape(-1, 2).sum(1, dtype=np.uint16))
                both = np.minimum(a, b).sum(1, dtype=np.int64)
                near[near] = both * (1 + similarity) >= similarity * (sizes[own[near]] + sizes[node]) - 1e-9
            left.append(np.full(int(near.sum()), node))
            right.append(own[near])
    return np.concatenate(left), np.concatenate(right)


def _byte_cuts(index: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The indices in parts of ``BLOCK_BYTES`` at most, or of one."""
    ends = np.cumsum(sizes[index])
    part = (ends - 1) // BLOCK_BYTES if len(ends) else ends
    return np.split(index, np.flatnonzero(np.diff(part)) + 1)


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8, radius: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, component_id, component, *carry) over links of at least this Jaccard similarity of word shingles.

    No link is missed.  Fingerprints of the sets of shingles within the radius, found through BK-trees, propose pairs
    first; they are near copies, which make up large groups.  Two sets this similar also share a member of their
    prefixes, the members that come first in one order for all: here the least frequent by counters over the corpus, so
    that what many texts quote makes no large groups.  Each set is proposed to be linked with the first one of every key
    of its prefix.  Proposals that sketches of the sets don't rule out are verified on the sets themselves (as 32-bit
    hashes), and make components; then all pairs of those keys whose sets are still in several components are compared,
    in the same two steps.  Texts with equal sets are one to the
    search, empty and null texts among them.  ``component_id`` is the smallest identifier reachable, null
    if none is known; ``component`` tells components apart where identifiers are null or repeated.  Rows keep their
    number; an empty table gives no row; the columns ``carry`` follow as they are, others are ignored.
    """
    found = materialize(_sets(df, id_col, text_col, ngram, carry), "sets")
    distinct = materialize(found.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("__n")), "distinct")
    n_shingles = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stars = materialize(_stars(_prefixes(found, _shingle_counts(found, n_shingles), similarity)), "stars")
    pairs = materialize(_candidates(_proposed(distinct, stars, radius), distinct, similarity), "pairs")
    labels = materialize(connected_components(_verified(pairs, found, similarity)).withColumnRenamed("v", "id"), "labels")
    later = connected_components(_completed(stars, labels, distinct, found, similarity)).select(F.col("v").alias("label"), F.col("label").alias("to"))
    full = distinct.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(later, "label", "left").select("id", "first", "__n", F.coalesce("to", "label").alias("component"))
    full = materialize(full, "full")
    smallest = full.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("__n"))
    named = by_group(full.withColumnRenamed("__n", "n"), materialize(smallest, "smallest"), ["component"]).select("id", "component_id", "component", F.col("n").alias("__n"))
    return by_group(found.select("doc_id", "id", *carry), materialize(named, "named"), ["id"]).select("doc_id", "component_id", "component", *carry)
