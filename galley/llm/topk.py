"""Exact top-k search by inner product over an index of distances to pivots.

Every vector is keyed by its nearest pivot and its distance to it, and the index is sorted by that key and cut into tiles of
bounded size; a tile holds its pivots' annuli, each a few hundred vectors with their least and greatest distance.  A query at
distance d of a pivot is at least ``gap`` from each vector of an annulus that d lies outside of by ``gap`` (the triangle
inequality), so no inner product there is above (|q|² + |v|² - gap²) / 2.  Queries first search the tile they are in
themselves, which gives a score that a result must reach; then each tile that can hold one, annulus by annulus with falling
bounds, until the bounds stay below what a query has.  Bounds only leave out what can't be a result, so the search is exact.

Tiles are rows of a written table: neither the index nor the queries are ever in one task or in the driver, which holds the
pivots and, where they are few, the tiles' bounds.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize, shuffle_partitions, tidied
from .vectors import MOST_SQUARES, longest, scaled, usable

#: Vectors of a tile, of an annulus, queries that are scored together, and pivots at most.
TILE, ANNULUS, TOGETHER, PIVOTS = 8192, 256, 512, 1024
#: Bytes of queries and tiles of a cell, about, and blocks of queries that a cell scores together.
GROUP, CELL, TOGETHER_BLOCKS = 8 << 20, 16, 8
#: Bounds of tiles (a pivot's part of a tile is one) that are sent to all tasks; of more, every tile meets every block of queries.
TOLD = 100_000

_FOUND = "qtile long, query long, query_id long, vec_id long, score long"


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a · b' of integers, exactly: as doubles if no sum leaves the integers that these hold, else as longs."""
    exact = len(a) and len(b) and float(np.sqrt(_squares(a.astype(np.float64)).max() * _squares(b.astype(np.float64)).max())) < 1 << 52
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all vectors of a and b, with an error far below the slack of ``bounds``."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    return np.sqrt((_squares(x.astype(np.float64))[:, None] + _squares(y.astype(np.float64))[None, :] - 2.0 * products(x, y)).clip(0))


def bounds(away: np.ndarray, squares: np.ndarray, near: np.ndarray, far: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Above every inner product of queries (rows) with vectors of annuli (columns).

    away: distances of queries to the annuli's pivots; squares: of the queries; near, far, most: least and greatest distance to
    the pivot and greatest square of the annuli's vectors.
    """
    gap = np.maximum(np.maximum(near[None, :] - away, away - far[None, :]), 0)
    total = squares[:, None] + most[None, :]
    return (total - gap * gap) / 2 + 1e-9 * total + 1


def _keyed(rows: DataFrame, dims: int, pivots: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, pivot, distance, squares, v): what a vector is sorted by, and its integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(start, 1 << 14)
                x = scaled(part.column(1), dims, scale)
                fits = _squares(x) < MOST_SQUARES
                x = x[fits].astype(np.int64)
                far = distances(x, pivots) if len(pivots) else np.zeros((len(x), 1))
                nearest = far.argmin(axis=1)
                kept = x.astype("<i4")  # a component is below 2^31 as its square is below 2^62
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(fits)), pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(x)), nearest]), pa.array(_squares(x)), pa.array([v.tobytes() for v in kept], pa.binary())],
                    names=["vec_id", "pivot", "distance", "squares", "v"],
                )

    ship(rows.sparkSession)
    return rows.mapInArrow(tidied(run), "vec_id long, pivot int, distance double, squares long, v binary")


def _tiles(keyed: DataFrame, dims: int, queries: Column, count: int) -> DataFrame:
    """(tile, ids, matrix, asked, pivot, begin, end, near, far, most): the sorted index, a row for each tile.

    ``asked`` are the places of queries; the last six are arrays over the tile's annuli.
    """
    placed = keyed.withColumn("asked", F.coalesce(queries, F.lit(False))).withColumn("__tie", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(count, "pivot", "distance", "vec_id", "__tie").sortWithinPartitions("pivot", "distance", "vec_id", "__tie").drop("__tie")

    def tile(at: int, table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        pivot, distance, squares = (table.column(c).to_numpy() for c in ("pivot", "distance", "squares"))
        cut = np.flatnonzero(np.diff(pivot)) + 1
        edges = sorted({e for a, b in zip([0, *cut], [*cut, len(pivot)], strict=True) for e in range(a, b, ANNULUS)})
        begin, end = np.array(edges, np.int32), np.array([*edges[1:], len(pivot)], np.int32)
        cells = [pivot[begin], begin, end, distance[begin], distance[end - 1], np.maximum.reduceat(squares, begin)]
        matrix = b"".join(table.column("v").to_pylist())
        asked = np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        values = [at, table.column("vec_id").to_pylist(), matrix, asked.tolist(), *(c.tolist() for c in cells)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["tile", "ids", "matrix", "asked", "pivot", "begin", "end", "near", "far", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, TILE - rows)
                held.append(part)
                rows, start = rows + part.num_rows, start + part.num_rows
                if rows == TILE:
                    yield tile(at, pa.Table.from_batches(held))
                    at, held, rows = at + 1, [], 0
        if rows:
            yield tile(at, pa.Table.from_batches(held))

    schema = "tile long, ids array<long>, matrix binary, asked array<int>, pivot array<int>, begin array<int>, end array<int>, near array<double>, far array<double>, most array<long>"
    return ordered.mapInArrow(tidied(run), schema)


class Tile:
    """A tile's annuli and vectors as arrays, of one row of the index."""

    def __init__(self, row: dict, dims: int):
        self.at, self.ids, self.asked = row["tile"], row["ids"], np.array(row["asked"], np.int64)
        self.matrix = np.frombuffer(row["matrix"], "<i4").reshape(len(self.ids), dims)
        self.pivot, self.begin, self.end = (np.array(row[c], np.int64) for c in ("pivot", "begin", "end"))
        self.near, self.far, self.most = (np.array(row[c], np.float64) for c in ("near", "far", "most"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def expand(tile: Tile, queries: np.ndarray, floor: np.ndarray, own: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, places, scores) in a tile: all results of the tile that reach a query's ``floor``, and some that other ones beat.

    Annuli are visited with falling bounds; a query takes part as long as a bound reaches the k-th score it has, or its floor.
    own: each query's own place in the tile, -1 elsewhere.
    """
    if not len(queries):
        return []
    used, where = np.unique(tile.pivot, return_inverse=True)
    away = distances(queries, pivots[used])[:, where] if len(pivots) else np.zeros((len(queries), len(tile.pivot)))
    limit = bounds(away, _squares(queries.astype(np.float64)), tile.near, tile.far, tile.most)
    floor, have, found = floor.copy(), np.full((len(queries), k), np.iinfo(np.int64).min), []
    order = np.argsort(-limit.max(axis=0), kind="stable")
    rest = np.maximum.accumulate(limit[:, order][:, ::-1], axis=1)[:, ::-1]  # the highest bound of what is still to come
    for step, a in enumerate(order):
        if not (rest[:, step] >= floor).any():
            break
        live = np.flatnonzero(limit[:, a] >= floor)
        if not len(live):
            continue
        begin, end = tile.begin[a], tile.end[a]
        scores = products(queries[live], tile.matrix[begin:end])
        mine = (own[live] >= begin) & (own[live] < end)
        take = scores >= floor[live][:, None]
        take[np.flatnonzero(mine), own[live[mine]] - begin] = False
        q, v = np.nonzero(take)
        if len(q):
            found.append((live[q], v + begin, scores[q, v]))
            masked = np.where(take, scores, np.iinfo(np.int64).min)
            both = np.concatenate([have[live], masked], axis=1)
            have[live] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor[live] = np.maximum(floor[live], have[live].min(axis=1))
    return found


def _kept(found: list, k: int, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what ``expand`` found the k best of each query, ties to the smaller identifier, null after all."""
    if not found:
        return (np.zeros(0, np.int64),) * 3
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
    known = np.array([i is not None for i in ids])
    number = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((number[v], ~known[v], -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], v[keep], s[keep]


def _asked(tiles: DataFrame, dims: int, pivots: np.ndarray, k: int, told: list[tuple] | None) -> DataFrame:
    """(qtile, places, ids, vectors, floors, home, to): blocks of queries, what they found in their own tile, and where else to look."""
    if told is not None:
        at, pivot, near, far, most = (np.array(c) for c in zip(*told, strict=True)) if told else (np.zeros(0, np.int64),) * 5
        numbers, part = np.unique(at, return_inverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                tile = Tile(row, dims)
                for start in range(0, len(tile.asked), TOGETHER):
                    places = tile.asked[start : start + TOGETHER]
                    vectors = tile.matrix[places]
                    q, v, s = _kept(expand(tile, vectors, np.full(len(places), np.iinfo(np.int64).min), places, pivots, k), k, tile.ids)
                    floors = np.full(len(places), np.iinfo(np.int64).min)
                    full = np.flatnonzero(np.bincount(q, minlength=len(places)) == k)
                    floors[full] = s[np.searchsorted(q, full, "right") - 1]  # sorted by falling score, so the last is the least
                    to = None
                    if told is not None:
                        away = distances(vectors, pivots) if len(pivots) else np.zeros((len(places), 1))
                        squares, hit = _squares(vectors.astype(np.float64)), np.zeros(len(pivot), bool)
                        for c in range(0, len(pivot), 4096):
                            some = slice(c, c + 4096)
                            hit[some] = (bounds(away[:, pivot[some]], squares, near[some], far[some], most[some]) >= floors[:, None]).any(axis=0)
                        to = [int(x) for x in numbers[np.unique(part[hit])] if x != tile.at]
                    home = [{"query": int(places[i]), "vec_id": tile.ids[j], "score": int(x)} for i, j, x in zip(q, v, s, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tile.at], pa.int64()), pa.array([places.tolist()], pa.list_(pa.int64())), pa.array([[tile.ids[p] for p in places]], pa.list_(pa.int64())), pa.array([vectors.tobytes()], pa.binary()), pa.array([floors.tolist()], pa.list_(pa.int64())),
                         pa.array([home], pa.list_(pa.struct([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))), pa.array([to], pa.list_(pa.int64()))],
                        names=["qtile", "places", "qids", "vectors", "floors", "home", "to"],
                    )

    return tiles.mapInArrow(tidied(run), "qtile long, places array<long>, qids array<long>, vectors binary, floors array<long>, home array<struct<query: long, vec_id: long, score: long>>, to array<long>")


def _cell(dims: int, pivots: np.ndarray, k: int):
    """What blocks of queries find in the tiles of their cell: a query's floor rises from tile to tile."""
    names = ["qtile", "query", "query_id", "vec_id", "score"]
    empty = pa.schema([(n, pa.int64()) for n in names]).empty_table()
    least = np.iinfo(np.int64).min

    def run(blocks: pa.Table, tiles: pa.Table) -> pa.Table:
        if not blocks.num_rows or not tiles.num_rows:
            return empty
        held = [Tile(tiles.slice(i, 1).to_pylist()[0], dims) for i in range(tiles.num_rows)]
        out = []
        for start in range(0, blocks.num_rows, TOGETHER_BLOCKS):
            own = list(_rows(blocks.slice(start, TOGETHER_BLOCKS)))
            vectors = np.concatenate([np.frombuffer(r["vectors"], "<i4").reshape(len(r["places"]), dims) for r in own])
            floor = np.concatenate([np.array(r["floors"], np.int64) for r in own])
            qtile = np.concatenate([np.full(len(r["places"]), r["qtile"]) for r in own])
            places, qids = [p for r in own for p in r["places"]], [i for r in own for i in r["qids"]]
            have, found = np.full((len(vectors), k), least), []
            for tile in held:
                asks = np.flatnonzero(qtile != tile.at)  # what is in a query's own tile has been found
                q, v, s = _kept(expand(tile, vectors[asks], floor[asks], np.full(len(asks), -1), pivots, k), k, tile.ids)
                if not len(q):
                    continue
                new, first = np.full((len(asks), k), least), np.flatnonzero(np.diff(q, prepend=-1))
                new[q, np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))] = s
                have[asks] = np.partition(np.concatenate([have[asks], new], axis=1), k, axis=1)[:, k:]
                floor[asks] = np.maximum(floor[asks], have[asks].min(axis=1))
                found.append((asks[q], np.array([tile.ids[j] for j in v], object), s))
            if found:
                q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = np.flatnonzero(s >= floor[q])
                columns = [qtile[q[keep]], [places[i] for i in q[keep]], [qids[i] for i in q[keep]], v[keep].tolist(), s[keep]]
                out.append(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
        return pa.concat_tables(out) if out else empty

    return run


def _elsewhere(sent: DataFrame, tiles: DataFrame, dims: int, pivots: np.ndarray, k: int, everywhere: bool, count: int) -> DataFrame:
    """What blocks of queries find in the tiles that can hold a result.

    Queries and tiles meet in cells: groups of blocks by groups of tiles, each of bounded size, so that a vector travels once for
    each group of the other side and not once for each pair, and no side is ever told to all.
    """
    asking = sent.agg(F.sum(F.size("places"))).first()[0] or 0
    wide = max(1, -(-asking * dims * 4 // GROUP))
    tall = max(1, min(count, max(-(-count // CELL), -(-shuffle_partitions(sent.sparkSession) // wide))))
    group = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    blocks = sent.withColumn("g", group(wide, "qtile", F.element_at("places", 1)))
    if everywhere:
        wanted = tiles.withColumn("tg", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
        blocks = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
    else:
        pairs = blocks.select(F.col("g").alias("tg"), F.explode("to").alias("tile")).distinct()
        wanted = tiles.join(pairs, "tile")
        blocks = blocks.withColumn("t", F.explode(F.array_distinct(F.transform("to", lambda x: group(tall, x)))))
    wanted = wanted.withColumn("tt", group(tall, "tile"))
    return blocks.drop("to").groupBy("g", "t").cogroup(wanted.groupBy("tg", "tt")).applyInArrow(_cell(dims, pivots, k), _FOUND)


def top_k(df: DataFrame, queries: Column | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all rows but itself, from rank 1.

    Components count as floor(scale * x).  ``queries`` is a condition on ``vec_id``; by default all rows ask.  Ties go to the
    smaller ``vec_id``, null last; all rows are given if there are fewer than k.  Vectors that are null or hold a null or a
    number that isn't finite take no part, nor do those whose squared length after scaling is 2^62 or more, as their scores
    would not fit a long; shorter vectors count as ending in zeros, so an empty one scores 0.  A row is a row: of repeated
    ones each asks and each may be found by the other.  An empty table gives no row; other columns are ignored.

    Pivots are a sample of at most ``PIVOTS`` rows, by a hash of their vectors; which ones doesn't change results.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    rows = usable(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("__own")), "vec_id", "__own")
    n, dims = longest(rows)
    drawn = rows.select("__v").orderBy(F.xxhash64("__v"), "__v").limit(min(PIVOTS, int(n**0.5))).collect() if dims else []
    sample = scaled(pa.array([r["__v"] for r in drawn], pa.list_(pa.float64())), dims, scale) if drawn else np.zeros((0, dims))
    pivots = np.unique(sample[_squares(sample) < MOST_SQUARES], axis=0).astype(np.int64)
    keyed = materialize(_keyed(rows, dims, pivots, scale), "keyed")
    tiles = materialize(_tiles(keyed, dims, F.lit(True) if queries is None else queries, max(1, -(-n // TILE))), "tiles")
    shape = tiles.select(F.sum(F.size(F.array_distinct("pivot"))), F.count("*")).first()
    told = None
    if (shape[0] or 0) <= TOLD:
        cells = tiles.select("tile", F.explode(F.arrays_zip("pivot", "near", "far", "most")).alias("c"))
        told = [tuple(r) for r in cells.groupBy("tile", "c.pivot").agg(F.min("c.near"), F.max("c.far"), F.max("c.most").cast("double")).collect()]
    asked = materialize(_asked(tiles, dims, pivots, k, told), "asked")
    home = asked.select("qtile", "places", "qids", F.explode("home").alias("h")).select("qtile", F.col("h.query").alias("query"), F.element_at("qids", F.array_position("places", F.col("h.query")).cast("int")).alias("query_id"), "h.vec_id", "h.score")
    found = home.unionByName(_elsewhere(asked.drop("home"), tiles, dims, pivots, k, told is None, shape[1]))
    order = Window.partitionBy("qtile", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
