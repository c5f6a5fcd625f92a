import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from galley.llm import quality_model, secret_scan, simhash
from galley.llm.vocabulary import Vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").select(*COLUMNS)
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, D)
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before) and len(now) == docs.count()
        if k == 1:
            assert len({t.lower() for t in now.values()}) == len(now)
        if k == 3:
            assert set(now) == set(before)
            assert all(t == before[d] or "<SECRET>" in t for d, t in now.items())
            assert not any(re.search(r"AKIA[A-Z0-9]{16}", t) for t in now.values() if not secret_scan.scan(t) == [] and "<SECRET>" in t)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


def row(r):
    return tuple(r[c] for c in COLUMNS)


def kept_of(rows, linked):
    """Groups of linked rows, each with the identifier that stays: the smallest, null only where there is no other."""
    groups = []
    for r in rows:
        near = [g for g in groups if any(linked(r, x) for x in g)]
        groups = [g for g in groups if g not in near] + [[r, *(x for g in near for x in g)]]
    return [(g, min((x.doc_id for x in g if x.doc_id is not None), default=None)) for g in groups]


def held_rows(odd):
    """The odd rows, an identifier with several texts and copies of each, and one more row without an identifier."""
    base = odd.select(*COLUMNS).collect()
    text = " ".join(f"word{i}" for i in range(60))
    more = [(500, t, "en", "s", None) for t in (text, text, text.upper(), text + " tail", "another text of this id", None)]
    return [tuple(r) for r in base] + more + [(None, "nobody knows where this one is from", "en", None, None)] * 3


def test_verdicts_are_on_rows(spark, odd):
    kind = odd.select(*COLUMNS).schema
    docs = spark.createDataFrame(held_rows(odd), kind).repartition(3)
    rows = docs.collect()
    labels = spark.read.parquet(f"{D}/labels.parquet")
    verdict = {r.copy: r.predicted for r in quality_model.classify(docs.withColumn("copy", F.col("text")), labels, carry=("copy",)).collect()}
    out = corpus_pipeline.quality_stage(spark, docs, D).collect()
    assert Counter(map(row, out)) == Counter(row(r) for r in rows if verdict[r.text] == 1)

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for stage, linked in ((corpus_pipeline.exact_stage, lambda a, b: (a.text or "").translate(low) == (b.text or "").translate(low)), (corpus_pipeline.near_stage, jaccard_linked())):
        left = stage(spark, docs, D).collect()
        groups = kept_of(rows, linked)
        assert len(left) == len(groups)
        for group, stays in groups:
            have = [r for r in left if row(r) in set(map(row, group)) and r.doc_id == stays]
            assert len(have) == 1


def jaccard_linked():
    sets = {}

    def shingled(t):
        if t not in sets:
            sets[t] = set(simhash.shingles(t or "", 5).tolist())
        return sets[t]

    return lambda a, b: len(shingled(a.text) & shingled(b.text)) >= 0.8 * len(shingled(a.text) | shingled(b.text))


def test_run_matches_brute_force(spark, tmp_path):
    """All stages on a small table; only the classifier's verdicts are taken from ``classify``."""
    base = spark.read.parquet(f"{D}/documents.parquet").select(*COLUMNS).orderBy("doc_id").limit(60)
    rows = [tuple(r) for r in base.collect()]
    long = [f"word{i}" for i in range(90)]
    secret, shared = "password = hunter2hunter2", "password = shared99shared99"
    more = [(None, " ".join(long), "en", "a", None), (901, " ".join(long), "en", "a", None), (902, " ".join([*long, "tail"]), "en", "b", None), (903, " ".join(f"own{i}" for i in range(80)) + " " + secret, "en", "c", None)]
    more += [(910 + k, " ".join(f"text{k}x{i}" for i in range(80)) + " " + shared, "en", f"s{k}", None) for k in range(3)] + [(None, "nobody knows " * 3 + " ".join(f"n{i}" for i in range(80)), "en", "n", None)] * 2
    spark.createDataFrame(rows + more, base.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    verdict = {r.copy: r.predicted for r in quality_model.classify(docs.withColumn("copy", F.col("text")), labels, carry=("copy",)).collect()}
    left = [r for r in docs.collect() if verdict[r.text] == 1]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for linked in (lambda a, b: (a.text or "").translate(low) == (b.text or "").translate(low), jaccard_linked()):
        left = [next(r for r in group if r.doc_id == stays) for group, stays in kept_of(left, linked)]
    assert {903, 910, 911, 912} <= {r.doc_id for r in left}
    owners = defaultdict(set)
    for r in left:
        for *_, value in secret_scan.scan(r.text or ""):
            owners[value].add(r.source)
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    want = Counter()
    for r in left:
        text, stop, out = r.text or "", 0, []
        for start, end, _, value in secret_scan.scan(text):
            if len(owners[value]) < 3:
                out += [text[stop:start], "<SECRET>"] if start >= stop else []
                stop = max(stop, end)
        ids = np.array([*own.encode_ordinary("".join([*out, text[stop:]])), 2], "<u4")
        at = piece = 0
        while at < len(ids):
            n = 1024 if at else len(ids) - (-(-len(ids) // 1024) - 1) * 1024
            want[r.doc_id, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, piece = at + n, piece + 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    for held in spans.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 1024
