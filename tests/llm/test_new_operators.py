"""Exact search, periodic runs and whitening against brute force, with odd rows."""
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import common, runs, topk, vectors, whitening
from galley.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x string, pivot string, score string, n string"


def rows_of(vecs):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", "p", "s", "n") for i, v in vecs]


def clean(vecs):
    return [(i, v) for i, v in vecs if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# 11


def brute_top_k(vecs, k, scale=256, every=50):
    """Rows are told apart by their place; ties go to the smaller identifier, null last."""
    dims = max((len(v) for _, v in vecs), default=0)
    x = [[int(np.floor(scale * float(c))) for c in v] + [0] * (dims - len(v)) for _, v in vecs]
    held = [(i, v) for (i, _), v in zip(vecs, x, strict=True) if sum(c * c for c in v) < 1 << 62]
    out = []
    for a, (q, v) in enumerate(held):
        if q is None or q % every:
            continue
        scores = sorted((-sum(s * t for s, t in zip(v, w, strict=True)), i is None, i or 0) for b, (i, w) in enumerate(held) if b != a)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found_top_k(spark, vecs, k=5, every=50):
    df = spark.createDataFrame(rows_of(vecs), VECTORS).repartition(3)
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k).collect()), key=str)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12))
    return [(i, (centres[i % 9] + 0.05 * rng.normal(size=12)).tolist()) for i in range(700)]


def test_top_k_matches_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "ANNULUS", 8)
    want = brute_top_k(clustered, 5)
    assert len(want) == 70 and found_top_k(spark, clustered) == want
    monkeypatch.setattr(topk, "TOLD", -1)  # bounds of tiles too many to be told
    assert found_top_k(spark, clustered) == want


def test_top_k_leaves_tiles_and_annuli_out(spark, clustered, monkeypatch):
    """On clusters most vectors are never scored."""
    monkeypatch.setattr(topk, "ANNULUS", 8)
    pivots = np.unique(np.floor(256 * np.array([v for _, v in clustered[:9]])).astype(np.int64), axis=0)
    x = np.floor(256 * np.array([v for _, v in clustered])).astype(np.int64)
    far = topk.distances(x, pivots)
    nearest = far.argmin(axis=1)
    order = np.lexsort((far[np.arange(len(x)), nearest], nearest))
    row = {"tile": 0, "ids": [int(i) for i in order], "matrix": x[order].astype("<i4").tobytes(), "asked": []}
    cut = [b for c in range(len(pivots)) for b in range(*np.searchsorted(nearest[order], [c, c + 1]), 8)]
    ends = [*cut[1:], len(x)]
    at = far[np.arange(len(x)), nearest][order]
    row |= {"pivot": nearest[order][cut].tolist(), "begin": cut, "end": ends, "near": at[cut].tolist(), "far": [at[e - 1] for e in ends], "most": [int((x[order][b:e] ** 2).sum(1).max()) for b, e in zip(cut, ends, strict=True)]}
    seen = []
    exact = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: (seen.append(len(a) * len(b)), exact(a, b))[1])
    tile = topk.Tile(row, 12)
    tile.begin, tile.end = np.array(cut), np.array(ends)
    topk.expand(tile, x[:5], np.full(5, np.iinfo(np.int64).min), np.full(5, -1), pivots, 5)
    assert sum(seen) < 5 * len(x) / 2


def test_top_k_sends_no_queries_to_all_tasks(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "GROUP", 256)
    monkeypatch.setattr(topk, "CELL", 2)
    monkeypatch.setattr(topk, "TOGETHER_BLOCKS", 2)
    assert found_top_k(spark, clustered) == brute_top_k(clustered, 5)
    plan = topk.top_k(spark.createDataFrame(rows_of(clustered), VECTORS), F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "BuildLeft" not in plan  # queries repeated for each tile were one side of a broadcast


def test_top_k_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "ANNULUS", 2)
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (3, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, []), (300, [5.0]), (9, [-1.0, -0.001, 4.0]), (350, [1e30, 1.0]), (11, [1e6, -3e6]), (400, [1e6, 2.0]), *[(1000 + i, [1.0, 2.0]) for i in range(20)]]
    want = brute_top_k(clean(vecs), 5)
    assert found_top_k(spark, vecs) == want
    assert brute_top_k(clean(vecs), 60) == found_top_k(spark, vecs, 60)  # fewer rows than asked for
    assert found_top_k(spark, []) == [] and found_top_k(spark, [(50, [1.0])]) == [] and found_top_k(spark, [(50, []), (1, [])]) == [(50, 1, 1, 0)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([], VECTORS), k=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 30), 1 << 30), min_size=3, max_size=3), min_size=1, max_size=12))
def test_products_are_exact(rows):
    x = np.array(rows, np.int64)
    assert topk.products(x, x).tolist() == [[sum(a * b for a, b in zip(r, s, strict=True)) for s in rows] for r in rows]


def test_op11_is_every_fiftieth(spark):
    got = QUERIES["op11_pivot_top_k"](spark, FOLDER).collect()
    assert len(got) == 50 and {r.rank for r in got} == {1, 2, 3, 4, 5} and all(r.query_id % 50 == 0 for r in got)


# 12


def brute_runs(w, least=24, exponent=3):
    smallest = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                smallest[i, j + p] = min(p, smallest.get((i, j + p), p))
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in smallest.items())


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 7)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(blocks, st.integers(0, 60), st.integers(0, 60), st.sampled_from([(3, 3), (6, 3), (10, 4), (24, 3)]))
def test_runs_match_brute_force(parts, begin, size, law):
    w = [x for block, times in parts for x in block * times]
    w += w[begin : begin + size] + [9] + w[begin // 2 :]  # copies, so that runs lie within blocks
    found = runs.runs(np.array(w, np.int64), *law)
    assert found == brute_runs(w, *law)
    assert not found or runs.suspects([["a", "b"], list(map(str, w))], *law)[1]


def test_longest_previous_factors():
    w = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2])
    ranks = runs.powers_of_ranks(w)
    order = np.argsort(ranks[-1])
    assert order.tolist() == sorted(range(10), key=lambda i: w[i:].tolist())
    lcp = np.zeros(10, np.int64)
    lcp[1:] = runs.common(ranks, order[1:], order[:-1])
    size, source = runs.previous_factors(order, lcp)

    def longest(i):
        return max((next((k for k in range(11 - i) if i + k == 10 or w[i + k] != w[j + k]), 0) for j in range(i)), default=0)

    assert size == [longest(i) for i in range(10)]
    assert all(s < 0 if not n else s < i and w[s : s + n].tolist() == w[i : i + n].tolist() for i, (n, s) in enumerate(zip(size, source, strict=True)))


def test_runs_odd_rows(spark, odd, none):
    long = " ".join(["a b c"] * 20000 + ["tail"])
    extra = spark.createDataFrame([(900, long), (901, "x " * 24), (902, "x " * 23), (903, "x y " * 30), (904, "\n".join(["one two"] * 12))], "doc_id long, text string")
    df = odd.select("doc_id", "text", "lang", F.lit("r").alias("runs"), F.lit(1).alias("collapsed")).unionByName(extra, allowMissingColumns=True)
    found = runs.periodic_runs(df).collect()
    assert len(found) == df.count()
    for r in found:
        text = {900: long, 901: "x " * 24, 902: "x " * 23, 903: "x y " * 30, 904: "\n".join(["one two"] * 12)}.get(r.doc_id)
        if text is not None:
            want = {900: [(0, 60000, 3)], 901: [(0, 24, 1)], 902: [], 903: [(0, 30, 1)], 904: [(0, 24, 2)]}[r.doc_id]
            assert [tuple(x) for x in r.runs] == want
            assert r.collapsed == {900: "a b c tail", 901: "x", 902: " ".join("x" * 23), 903: "x y", 904: "one two"}[r.doc_id]
    assert all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in runs.periodic_runs(df.where("text is null or trim(text) = ''")).collect())
    assert runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, exponent=2)


def test_op12(spark):
    import duckdb

    word = re.compile(r"[^\x20\x09-\x0D]+")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    some = 0
    for i, text in duckdb.sql(f"select doc_id, text from read_parquet('{FOLDER}/documents.parquet')").fetchall():
        w = word.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if n > 3000:
            continue
        found = brute_runs(w)
        gone = {j for s, length, q in found for j in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        some += bool(found)
        assert got[i] == (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    assert some > 10


# 13


def brute_whitening(vecs, components=16, scale=64, offset=1_000_000):
    dims = max((len(v) for _, v in vecs), default=0)
    x = [[int(np.floor(scale * float(c))) + offset for c in v] + [offset] * (dims - len(v)) for _, v in vecs]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, deviation, values[order], directions[:, order], np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, v) for i, v in enumerate((rng.normal(size=(400, 20)) * np.linspace(0.2, 4, 20)).tolist())]
    vecs += [(1000 + i, v) for i, (_, v) in enumerate(vecs[:50])] + [(0, vecs[0][1]), (None, vecs[1][1])]  # repeated vectors are fitted once
    rows = rows_of([*vecs, (5000, None), (5001, [None] * 20), (5002, [float("nan")] * 20), (5003, [float("-inf")] * 20)])
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    n, deviation, values, directions, centred = brute_whitening(vecs)
    assert len(got) == 16 * len(vecs) and n == 400
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    made = np.array([[by_id[i][c].whitened for c in range(1, 17)] for i, _ in vecs])
    want = centred @ directions[:, :16] / np.sqrt(values[:16])
    assert np.abs(made * np.sign((made * want).sum(0)) - want).max() < 1e-9
    for (i, _), d in zip(vecs, deviation, strict=True):
        r = by_id[i][3]
        assert (r.n, r.deviation) == (n, d) and abs(r.explained / (values[2] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    def run(vecs, **more):
        return whitening.whiten(spark.createDataFrame(rows_of(vecs), VECTORS), **more).collect()

    assert run([]) == [] and run([(1, [])]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    got = run([(1, [1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 3.0, 0.0]), (4, [1e300, 0.0]), (5, [1e12, 0.0, -1e12])])
    assert {r.vec_id for r in got} == {1, 2, None, 5} and {r.component for r in got} <= {1, 2, 3} and all(r.identity_error < 1e-4 and r.n == 4 for r in got)
    assert any(r.deviation is None for r in got)  # over a long
    with pytest.raises(ValueError):
        run([], components=0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 61), 1 << 61) | st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=9))
def test_scatter_is_exact(rows):
    n, sums, products = whitening.scatter(np.array(rows, np.int64))
    assert n.tolist() == [len(rows)] and sums.tolist() == [sum(c) for c in zip(*rows, strict=True)]
    assert products.tolist() == [sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(3)]


def test_exact_tree_sums(spark):
    df = spark.range(0, 1000, 1, 40).select((F.col("id") + (1 << 61)).alias("v"))
    (total,) = common.tree_sum(df, lambda b: [np.array([sum(b.column(0).to_pylist()), -1], object)], fan_in=3, exact=True)
    assert total[0] == sum(range(1000)) + 1000 * (1 << 61) and total[1] < 0


def test_scaled_vectors():
    import pyarrow as pa

    held = pa.array([[0.5, -0.1], [], [1.0]], pa.list_(pa.float64()))
    assert vectors.scaled(held, 2, 64).tolist() == [[32.0, -7.0], [0.0, 0.0], [64.0, 0.0]]
    assert vectors.scaled(held.slice(0, 1), 2, 64).tolist() == [[32.0, -7.0]]


def test_op13(spark):
    got = QUERIES["op13_whitening"](spark, FOLDER).collect()
    assert len(got) == 500 * 16 and {r.n for r in got} == {500} and len({(r.component, r.explained) for r in got}) == 16
    w = np.zeros((500, 16))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-8


# 9


def test_cutoffs_move_with_each_document(spark):
    """One document more moves a group's cutoff by little, at every size: no number of rows at which it takes others."""
    from galley.llm import quality_rules

    def cutoff(n):
        rows = [("en", "own", "symbols", 16, n), ("en", "rest", "symbols", 64, 5000), ("fr", "rest", "symbols", 2, 5000)]
        rows += [(*r[:2], m, 1, r[4]) for r in rows for m in ("word_length", "dup_lines", "repeats", "capitals", "marks")] + [(*r[:2], f"{m}_item", 1, r[4]) for r in rows for m in quality_rules.METRICS]
        found = quality_rules.limits(quality_rules.blended(quality_rules.quartiles(spark.createDataFrame(rows, "lang string, source string, metric string, value long, n long"))))
        return found.where("source = 'own'").first().limits.symbols_high

    seen = [cutoff(n) for n in (1, 10, 50, 99, 100, 101, 1000, 100000)]
    assert seen == sorted(seen, reverse=True) and seen[0] > 60 and seen[-1] == 24
    assert all(a - b <= 1 for a, b in zip(seen[3:6], seen[4:6], strict=False))
