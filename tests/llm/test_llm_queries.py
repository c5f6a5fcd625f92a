"""The query functions over the smallest tables: against their SQL, or against public libraries and brute force."""
import hashlib
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from galley.llm import simhash
from galley.llm.pretokens import ranks_of_tiktoken
from galley.llm.queries import QUERIES
from galley.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{FOLDER}/documents.parquet')").fetchall()
    return [(d, t or "") for d, t in rows]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    asked = con.execute(ORACLES[name])
    named = [c[0] for c in asked.description]
    assert sorted(named) == columns
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    want = Counter(tuple(plain(r[named.index(c)]) for c in columns) for r in asked.fetchall())
    assert Counter(tuple(map(plain, r)) for r in found.select(*columns).collect()) == want and want


def test_op1(spark, documents):
    prints = [simhash.fingerprint(t) for _, t in documents]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(documents):
        least[find(i)].append(d)
    want = {(d, f"{prints[i]:016x}", min(least[find(i)])) for i, (d, _) in enumerate(documents)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_bk_trees"](spark, FOLDER).collect()} == want


def test_op5(spark, documents):
    library, found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    bins = defaultdict(list)
    for r in QUERIES["op5_best_fit_packing"](spark, FOLDER).collect():
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, t in documents:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        assert sorted(found.pop(d)) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert not found and len(bins) <= 1.02 * -(-total // 1024) + 1
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)]).tolist()
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_op8(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, FOLDER).collect()}
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{FOLDER}/labels.parquet')").fetchall()
    assert len(found) == len(documents) and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for d, r in found.items())
    held = [(found[d].predicted, q) for d, q in labels if found[d].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_op10(spark, documents):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_tiktoken(f.read()), special_tokens={})
    want = set()
    for d, t in documents:
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.add((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op10_byte_bpe"](spark, FOLDER).collect()} == want
