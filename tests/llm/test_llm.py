import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import bpe_words, chat, common, components, exact_dedup, packing, pretokens, quality_model, quality_rules, secret_scan, sharding, simhash, warc
from galley.llm.docstats import NAMES, stats
from galley.llm.vocabulary import Vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_fingerprint(text, n=3):
    words = WORDS.findall(text.translate(LOWER))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


# 1


def test_simhash_matches_brute_force(odd):
    found = simhash.near_duplicates(odd).collect()
    docs = pairs(odd)
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter()
    for (d, _), p, r in zip(docs, prints, roots, strict=True):
        ids = [x for (x, _), y in zip(docs, roots, strict=True) if y == r and x is not None]
        want[d, f"{p:016x}", min(ids, default=None)] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar_documents(none).count() == 0


def test_links_of_a_hot_shard(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 63))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in rng.integers(0, 7, 600)})
    monkeypatch.setattr(simhash, "TREE", 40)
    made = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), len(values), 3)
    labels = {r.v: r.label for r in components.connected_components(made).collect()}
    roots = classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = [labels.get(v, ("alone", v)) for v in values]
    assert len(set(zip(roots, mine, strict=True))) == len(set(roots)) == len(set(mine))


@pytest.mark.parametrize("n", [1, 10**6, 10**9, 10**12])
def test_masks_leave_no_pair_out(n):
    rng = np.random.default_rng(n % 97)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(diff & m == 0 for m in simhash.masks(n, 3))


def test_bk_tree_search():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    tree = simhash.BKTree(values)
    got = {(int(n), int(q)) for n, near in tree.search(values, 2) for q in near}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_similar_documents(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(25):
        base = rng.choice(words, 200).tolist()
        for c in range(6):
            own = list(base)
            for p in rng.choice(200, c * 2, replace=False):
                own[p] = f"e{g}x{c}x{p}"
            docs.append((len(docs), " ".join(own)))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in docs]
    roots = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert len({*zip(roots, (found[d] for d, _ in docs), strict=True)}) == len(set(roots)) == len(set(found.values()))
    assert all(found[d] <= d for d, _ in docs)


def test_a_repeated_passage_costs_no_link(spark):
    rng = np.random.default_rng(8)
    docs = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in rng.integers(0, 10**6, 150)]
        chant = base[:8] * 300  # most of the second text, and few of its distinct shingles
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, *chant]))]
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in docs]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: d - d % 2 for d, _ in docs}


def test_short_texts_at_the_threshold(spark):
    docs = [(k, " ".join(f"t{k // 2}w{i}" for i in range(8 + k % 2))) for k in range(2000)]  # four shingles and five
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: d - d % 2 for d, _ in docs}


def test_counters_grow_with_the_corpus():
    assert [simhash._counter_bits(n) for n in (0, 1000, 1 << 30, 1 << 32, 1 << 50)] == [20, 20, 21, 23, 24]


@pytest.mark.parametrize("many,block,few,bits", [(10**5, 1024, 10**5, 20), (6, 8, 4, 20), (0, 8, 4, 4)])
def test_no_link_is_missed(spark, monkeypatch, many, block, few, bits):
    """Pairs about the threshold, chains, a passage in most texts, one large group; salted keys, small blocks, shuffled joins, full counters."""
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "LEAST_BITS", bits)
    monkeypatch.setattr(simhash, "MOST_BITS", bits)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(common, "FEW_GROUPS", few)
    monkeypatch.setattr(simhash, "FEW_SETS", few)
    monkeypatch.setattr(simhash, "DENSE", 8 if many > 6 else 0.6)
    rng = np.random.default_rng(11)
    passage, docs = [f"p{i}" for i in range(50)], []
    for g in range(60):
        n = int(rng.integers(3, 90))
        base = [f"g{g}w{i}" for i in range(n)]
        for c in range(30 if g == 7 else int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + n // 12))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(10**9)}"
            own = own[: int(rng.integers(max(1, int(0.8 * n)), n + 1))]
            docs.append((len(docs), " ".join([*own, *passage] if g % 2 else own)))
            if c % 2 == 0:
                base = own if len(own) > 2 else base  # a chain: the next copy is a copy of this one
    docs += [(len(docs) + k, " ".join([*passage, *[f"t{k}e{i}" for i in range(k)]])) for k in range(14)]
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in docs]
    roots = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert [found[d] for d, _ in docs] == [min(d for (d, _), x in zip(docs, roots, strict=True) if x == r) for r in roots]
    assert 20 < len(set(roots)) < len(docs) - 20


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(2)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 32, n, np.uint32))
        b = np.unique(np.concatenate([rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False), rng.integers(0, 1 << 32, int(rng.integers(0, 200)), np.uint32)]))
        may = simhash.may_be_similar(simhash.sketch(a), simhash.sketch(b), len(a), len(b), 0.8)
        similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        assert may or not similar
        assert simhash.jaccard_at_least(a, b, 0.8) == similar
        two = np.array([simhash.sketch(a), simhash.sketch(b)], object)
        got = simhash._partners(two, np.array([len(a), len(b)]), np.array([1, 2]), np.array([0]), np.array([1]), 0.8)
        assert (len(got[0]) == 1) == may
        ruled += not may
    assert ruled > 200 and simhash.sketch(np.arange(5000, dtype=np.uint32)) == b""


def test_prefixes_meet_at_the_threshold():
    for a in range(1, 60):
        for b in range(a, 75):
            both = math.ceil(0.8 * (a + b) / 1.8 - 1e-9)
            if both <= a:  # the last members in common, all others first
                assert simhash._prefix_length(a, 0.8) > a - both and simhash._prefix_length(b, 0.8) > b - both


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    found = {r.v: r.label for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and found[100] == found[101] != found[0]


# 2


def test_secrets_match_brute_force(odd):
    found = secret_scan.secret_scan(odd).collect()
    assert len(found) == odd.count()
    texts = defaultdict(list)
    for d, t in pairs(odd):
        texts[d].append(t)
    for r in found:
        assert any((r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute_secrets(t) for t in texts[r.doc_id])


def brute_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokensecrpawdAKI:='\" 0123abcdef+/_ſK\n", max_size=120))
def test_scan_base_kinds(text):
    base = [x for x in secret_scan.scan(text) if x[2] < 3]
    assert (sum(k == 0 for *_, k, _ in base), sum(k == 1 for *_, k, _ in base), sum(k == 2 for *_, k, _ in base), hashlib.sha256(secret_scan.span_text(base).encode()).hexdigest()) == brute_secrets(text)


def test_ownership_separates_examples(spark):
    shared, own = "password = hunter2hunter2", "password = mine99mine99"
    rows = [(i, shared, f"s{i}") for i in range(5)] + [(9, own, "s9"), (10, own, "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = secret_scan.secret_scan(df)
    found = {r.doc_id: (r.n_live, r.n_example) for r in judged.collect()}
    assert found[0] == (0, 1) and found[9] == (1, 0)
    clean = {r.doc_id: r.text for r in secret_scan.redact(df, judged).collect()}
    assert clean[0] == shared and clean[9] == "<SECRET>" and len(clean) == 7


@pytest.mark.parametrize("few,told", [(10**5, 32 << 20), (3, 0)])
def test_verdicts_and_redaction_by_brute_force(spark, monkeypatch, few, told):
    """Copied examples, one owner's many copies, two owners' few and many; all spans and redacted texts are compared."""
    monkeypatch.setattr(common, "FEW_GROUPS", few)
    monkeypatch.setattr(secret_scan, "TOLD_BYTES", told)
    rng = np.random.default_rng(4)
    values = [f"password = {''.join(rng.choice(list('abcdef0123'), 12))}" for _ in range(20)] + [f"AKIA{k:016d}" for k in range(10)] + ["".join(rng.choice(list("ABCdefGH0123456789xyz"), 30)) for _ in range(20)]
    rows = []
    for k, v in enumerate(values):
        for c in range(int(rng.integers(1, 25))):
            owner = f"o{c % (1 + k % 4)}" if (k + c) % 9 else None
            rows.append((len(rows), f"before {v}, then {values[(k + c) % 50]} é 🙂 end" if c % 3 else v, owner, f"r{c // 2}"))
    rows += [(None, values[0], "o1", None), (None, None, None, None), (7, "", "o1", "r"), (3, values[3], "o9", "r0"), (3, values[3], "o9", "r0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string").repartition(4)
    judged = secret_scan.secret_scan(df, repo=F.col("repo"))
    who = defaultdict(set)
    for _, t, o, r in rows:
        for *_, v in secret_scan.scan(t or ""):
            who[v].add((o, r))
    live = {v: not (len({o for o, _ in w}) >= 3 or (len({o for o, _ in w}) == 2 and len(w) >= 10)) for v, w in who.items()}
    assert len(set(live.values())) == 2
    want, clean = Counter(), Counter()
    for d, t, o, r in rows:
        spans = [x for x in secret_scan.scan(t or "") if x[2] < 3 or live[x[3]]]
        want[d, secret_scan.span_text(spans), sum(live[x[3]] for x in spans)] += 1
        out, stop = "", 0
        for s, e, _, v in spans:
            if live[v]:
                out, stop = (out + (t[stop:s] + "<SECRET>" if s >= stop else "")), max(stop, e)
        clean[d, None if t is None else out + t[stop:], o, r] += 1
    spans = lambda r: ",".join(f"{s.kind_name}:{s.start}:{s.stop}" for s in r.spans)
    assert Counter((r.doc_id, spans(r), r.n_live) for r in judged.collect()) == want
    assert Counter(tuple(r) for r in secret_scan.redact(df, judged).collect()) == clean


def test_secrets_of_nothing(none):
    judged = secret_scan.secret_scan(none)
    assert judged.count() == 0 and secret_scan.redact(none, judged).count() == 0


def test_redaction_keeps_rows_and_columns(odd):
    out = secret_scan.redact(odd, secret_scan.secret_scan(odd))
    assert out.columns == odd.columns and out.count() == odd.count()


# 3


@pytest.fixture
def chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn>x\\b\\e"), (2, 1, "assistant", "a"), (2, 0, "user", None), (3, 0, "assistant", "first"), (4, None, None, None), (None, 0, "ro\nle<turn>", "t"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(chats):
    made = chat.format_chats(chats).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = defaultdict(list)
    for r in chats.collect():
        want[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    assert {r.conv_id: [tuple(x) for x in r.back] for r in made} == {k: [x[1:] for x in sorted(v)] for k, v in want.items()}
    for r in made:
        assert r.loss == "".join(x[2] for x in sorted(want[r.conv_id]) if x[1] == "assistant")
    assert {r.conv_id: r.valid for r in made} == {1: True, 2: True, 3: False, 4: False, None: False, 5: False}


def test_chat_of_long_texts_beside_clashing_columns(spark):
    long = "\\b<turn>é🙂\n" * 30000
    df = spark.createDataFrame([(1, 0, "user", long, "x", 1, None), (1, 1, "assistant", long, "y", 2, None)], "conv_id long, turn long, role string, text string, formatted string, segments int, turns string")
    (r,) = chat.format_chats(df).select("n_turns", "valid", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert (r.n_turns, r.valid, r.loss) == (2, True, long) and [tuple(x) for x in r.back] == [("user", long), ("assistant", long)]


def test_chat_of_nothing(chats):
    assert chat.format_chats(chats.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open="aa")


# 4


def test_shards(odd, none):
    out = sharding.shuffle_shards(odd, shards=5, bucket_bytes=4000)
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[i]) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == odd.count()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert all(r.size == len((r.text or "").encode()) + 1 for r in rows) and {"lang", "fp", "bucket"} - set(out.columns) == {"bucket"}
    assert sharding.shuffle_shards(none).count() == 0


def test_sharding_repeats_and_mixes(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    one, two = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shuffle_shards(df, bucket_bytes=8000).collect()) for _ in range(2))
    assert one == two
    inverse = sum(a[1:] > b[1:] for a, b in zip(one, one[1:], strict=False))
    assert 150 < inverse < 350


def test_copies_of_one_row_are_spread(spark):
    """A third of all rows are one row; no bucket holds more of them than its share."""
    df = spark.range(0, 9000, numPartitions=3).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    found = sharding.shuffle_shards(df, shards=4, seed=3, bucket_bytes=20000)
    assert Counter(r.shard for r in found.collect()) == {0: 2250, 1: 2250, 2: 2250, 3: 2250}
    hot = Counter(r.shard for r in found.where("doc_id is null").collect())
    assert sum(hot.values()) == 3000 and all(600 < n < 900 for n in hot.values())


# 5


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_everything_once(counts):
    ranges, n = packing.plan(counts, 64)
    used, load = Counter(), Counter()
    spans = defaultdict(list)
    for length, first, many, sequence, offset in ranges:
        used[length] += many
        for i in range(many):
            load[sequence + i] += length
            spans[sequence + i].append((offset, length))
    assert used == Counter(counts) and len(load) == n and max(load.values(), default=0) <= 64
    for held in spans.values():
        assert [o for o, _ in sorted(held)] == [sum(x for _, x in sorted(held)[:i]) for i in range(len(held))]
    total = sum(k * v for k, v in counts.items())
    halves = sum(v for k, v in counts.items() if 2 * k > 64)
    assert n <= max(halves, -(-total // 64)) * 1.5 + 2


def test_packing(spark, odd, none):
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(odd, vocabulary, capacity=256).collect()
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    want = Counter()
    for d, t in pairs(odd):
        ids = np.array([*own.encode_ordinary(t), 2], "<u4")
        at, piece = 0, 0
        while at < len(ids):
            n = 256 if at else len(ids) - (-(-len(ids) // 256) - 1) * 256
            want[d, piece, at, n, ids[at : at + n].tobytes()] += 1
            at, piece = at + n, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in found) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        end = 0
        for o, n in sorted(held):
            assert o == end
            end += n
        assert end <= 256
    assert packing.pack(none, vocabulary).count() == 0


def test_ids_as_the_library_gives_them(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", " <|endoftext|>\n\n", "plain", ""]
    found = packing.pack(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), Vocabulary(spark, path)).collect()
    for r in found:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]


def fewest(lengths: list[int], capacity: int) -> int:
    """The least number of sequences, by trying every placement."""
    best = len(lengths)

    def place(i: int, bins: tuple[int, ...]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + lengths[i] <= capacity:
                rest = list(bins)
                rest.remove(k)
                place(i + 1, tuple([*rest, k + lengths[i]]))
        place(i + 1, (*bins, lengths[i]))

    place(0, ())
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=8))
def test_plan_against_every_placement(lengths):
    """Pairs of large pieces are as good as any; best fit of the small ones adds one sequence at most at this size."""
    least = fewest(sorted(lengths, reverse=True), 24)
    assert packing.plan(Counter(lengths), 24)[1] <= least + 1
    large = [n for n in lengths if 3 * n > 24]
    assert packing.plan(Counter(large), 24)[1] == fewest(sorted(large, reverse=True), 24)


def test_json_vocabulary_encodes_as_its_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = pretokens.encoder(pretokens.ranks_of_json(open(path, "rb").read()))
    text = "Hello  wörld's <|endofte|> 日本 123\n\n  x\t!!'re"
    index, distinct, _ = pretokens.words([text])
    words = pretokens.as_bytes(distinct)
    assert [i for k in index for i in encode(words[k])] == t.encode(text, add_special_tokens=False).ids


# 6


def test_arc_versions():
    for version in (1, 2):
        first = warc.arc_start(version, "a.arc", "20240101000000")
        records = [warc.arc_record(version, "http://x/a b", "20240102", b"body\n\nmore", 5), warc.arc_record(version, "", "19990101000000", b"", None)]
        found = list(warc.parse_arc(b"\n".join([first, *records, b""])))
        assert [r["url"] for r in found] == ["filedesc://a.arc", "http://x/a%20b", "-"]
        assert [warc.split_http(r["content"])[1] for r in found[1:]] == [b"body\n\nmore", b""]
    with pytest.raises(ValueError):
        list(warc.parse_arc(first + b"\nhttp://x 0 0 text/html 9999\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 0 0 text/html 0\n"))
    assert warc.iso_date("1999") == "1999-01-01T00:00:00Z" and warc.iso_date("x") == "1970-01-01T00:00:00Z"


def test_pages_with_null_ids_and_clashing_columns(spark):
    long = "<p>" + "long page é " * 200000
    rows = [(None, "u", long, "d", 1), (None, "u", long, "d", 1), (3, "u", long, "d", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, path int").repartition(2)
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df).collect())
    n = len(long.encode())
    assert found == {(3, n, "response", None): 1, (None, n, "revisit", 3): 2, (None, 0, "response", None): 1}


def test_damage_is_kept_apart():
    first = warc.arc_start(1, "a.arc", "20240101000000")
    good = [warc.arc_record(1, f"http://x/{i}", "20240102000000", b"body", i) for i in range(3)]
    data = b"\n".join([first, good[0], b"broken line", good[1], b"http://y 0 2024 text/html 9x", good[2], b"cut"])
    found = list(warc.parse_arc(data, "keep"))
    assert [r["url"] for r in found] == ["filedesc://a.arc", "http://x/0", "-", "http://x/1", "-", "http://x/2", "-"]
    assert [r["content"] for r in found if r["type"] == "damaged"] == [b"broken line", b"http://y 0 2024 text/html 9x", b"cut"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_inflated_members_and_offsets():
    import gzip

    data = bytes(range(256)) * 20000
    for content in (data, gzip.compress(data), b"".join(warc.member(data[i : i + 777]) for i in range(0, len(data), 777)) + b"\0" * 9):
        source = warc.Inflated(content)
        assert source.take(3) == data[:3] and source.until(b"\xff\x00") == data[3:255] and source.offset == 257
        assert source.take(len(data) - 257) == data[257:] and source.take(1) is None and source.ends()
    with pytest.raises(ValueError):
        warc.Inflated(gzip.compress(data)[:-9]).take(len(data) + 1)
    raw = b"".join(warc.member(warc.warc_record("response", "u", "d", f"r{i}", b"", b"x" * i, "0", i, {}) + b"\r\n\r\n") + warc.member(b"") for i in range(5))
    for fields, block, at in warc.parse_warc(raw):
        again = next(warc.parse_warc(raw[at:]))
        assert again[0] == fields and again[1] == block


def test_any_archive_converts(spark, tmp_path):
    """Binary payloads, one stream of many records, any file name, folders within the folder."""
    import gzip

    (tmp_path / "arcs/deep").mkdir(parents=True)
    latin = "déjà vu ".encode("latin-1") * 40 + bytes(range(256))
    files = {"arcs/IA-0001.arc.gz": gzip.compress, "arcs/deep/x.arc": bytes}
    for k, (name, squeeze) in enumerate(files.items()):
        records = [warc.arc_record(1 + k, f"http://x/{k}{i}", "20240102000000", latin, 10 * k + i) for i in range(3)]
        plain = "http://x/dns 0.0.0.0 20240101 text/dns 5" if k == 0 else "http://x/dns 0.0.0.0 20240101 text/dns 200 - - 0 n 5"
        (tmp_path / name).write_bytes(squeeze(b"\n".join([warc.arc_start(1 + k, name, "20240101000000"), *records, plain.encode() + b"\nhello", b""])))
    warc.convert(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    found = warc.read_warcs(spark, str(tmp_path / "warcs")).collect()
    assert Counter(r["record_type"] for r in found) == {"resource": 2, "response": 1, "revisit": 5}
    (first,) = (r for r in found if r["record_type"] == "response")
    assert first["page_id"] == 0 and first["payload_digest"] == hashlib.sha256(latin).hexdigest()
    assert {r["refers_to_id"] for r in found if r["record_type"] == "revisit"} == {first["record_id"]}


def test_archives_of_other_writers(spark, tmp_path):
    """Other record types, digests in base 32 and other algorithms, folded and differently spelt fields, one stream of records."""
    import base64
    import gzip

    body = "<p>déjà vu</p>".encode()
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def record(block, **fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\n{head}content-length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [
        record(b"software: x\r\n", WARC_Type="warcinfo", WARC_Record_ID="<urn:a>"),
        record(b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", WARC_Type="request", WARC_Record_ID="<urn:b>", WARC_Target_URI="http://h/"),
        record(http + body, WARC_Type="response", WARC_Record_ID="<urn:c>", WARC_Payload_Digest=sha1, WARC_Target_URI="http://h/\r\n\tlong"),
        record(http, warc_type="revisit", WARC_Record_ID="<urn:d>", WARC_Payload_Digest=sha1, WARC_Refers_To="<urn:c>"),
        record(b"k: v\r\n", WARC_Type="metadata", WARC_Record_ID="<urn:e>", WARC_Payload_Digest="blake3:00ff"),
        record(body, WARC_Type="resource", WARC_Record_ID="<urn:f>", WARC_Payload_Digest="SHA-256:" + hashlib.sha256(body).hexdigest().upper()),
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "b.warc").write_bytes(records[2])
    found = {(r["path"][-1], r["record_id"]): r for r in warc.read_warcs(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {k[1]: (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to_id"]) for k, r in found.items() if k[0] == "z"}
    assert got == {
        "<urn:a>": ("warcinfo", 13, sha(b"software: x\r\n"), None), "<urn:b>": ("request", 0, sha(b""), None), "<urn:c>": ("response", len(body), sha(body), None),
        "<urn:d>": ("revisit", None, None, "<urn:c>"), "<urn:e>": ("metadata", 6, sha(b"k: v\r\n"), None), "<urn:f>": ("resource", len(body), sha(body), None),
    }
    assert len(found) == 7 and found["c", "<urn:c>"]["url"] == "http://h/ long" and found["c", "<urn:c>"]["declared_digest"] == sha1
    (tmp_path / "c.warc").write_bytes(records[2].replace(b"vu</p>", b"vu</q>"))
    with pytest.raises(Exception, match="isn't what its digest says"):
        warc.read_warcs(spark, str(tmp_path)).collect()


def test_a_page_of_most_rows(spark, monkeypatch):
    """One page copied 12,000 times, beside a clashing column; revisits told by broadcast and by a join."""
    big = "<p>" + "hot " * 50
    df = spark.range(0, 15000, numPartitions=5).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 5 < 4, big).otherwise(F.concat(F.lit(big), "id")).alias("html"), F.lit(1).alias("digest"))
    for told in (1 << 20, 0):
        monkeypatch.setattr(warc, "TOLD_BYTES", told)
        found = warc.archive(df).groupBy("record_type", "refers_to").count().collect()
        assert sorted((r["record_type"], r["refers_to"], r["count"]) for r in found) == [("response", None, 3001), ("revisit", 0, 11999)]


def test_archives_round_trip(spark):
    big = "<p>" + "same payload " * 20
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, big), (4, "http://c", "tiny"), (5, "http://c", "tiny"), (6, "http://d", None), (7, "http://e", ""), (8, "http://f", "WARC/1.1\r\n\r\nfiledesc://x\n日本"), (1, "http://b", big), (None, "http://g", big), (9, "u", "é" * 200000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = Counter(tuple(r) for r in warc.archive(df).collect())
    want = Counter()
    seen = False
    for p, _, h in rows:
        data = (h or "").encode()
        copy = h == big and (p != 1 or seen)
        seen = seen or (h == big and p == 1)
        want[p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", 1 if copy else None] += 1
    assert found == want
    assert warc.archive(df.limit(0)).count() == 0


# 7


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 4])
def test_exact_dedup(odd, none, keep, fan_in):
    docs = [(d, t.translate(LOWER)) for d, t in pairs(odd)]
    ids = defaultdict(list)
    for d, t in docs:
        ids[t].append(d)
    pick = max if keep == "largest" else min
    want = Counter()
    for d, t in docs:
        k = pick((x for x in ids[t] if x is not None), default=None)
        want[d, k, len(ids[t]), d == k, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(odd, keep=keep, fan_in=fan_in).collect()) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_runs_merge_as_one_sort():
    rng = np.random.default_rng(3)
    runs, rows = [], []
    for n in (0, 1, 7, 400, 33):
        run = np.zeros(n, exact_dedup.ENTRY)
        run["key"] = [bytes(rng.integers(0, 3, 2, np.uint8)) * 24 for _ in range(n)]
        run["low"] = run["high"] = rng.integers(-9, 9, n)
        run["n"] = 1
        rows += run.tolist()
        runs.append(exact_dedup.collapse(run[np.argsort(run["key"], kind="stable")]))
    want = {}
    for k, low, high, n in rows:
        a = want.get(k, (low, high, 0))
        want[k] = min(a[0], low), max(a[1], high), a[2] + n
    assert [(k, (a, b, n)) for k, a, b, n in exact_dedup.merge(runs).tolist()] == sorted(want.items())


def test_exact_dedup_of_a_hot_text(spark, monkeypatch):
    """Half of 30,000 rows are one text; small runs, small ranges, groups beyond what is broadcast."""
    monkeypatch.setattr(common, "FEW_GROUPS", 10)
    monkeypatch.setattr(exact_dedup, "RANGE_ENTRIES", 500)
    df = spark.range(0, 30000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 10).cast("int"))).alias("text"))
    found = exact_dedup.exact_dedup(df).groupBy("group_size", "kept").count().collect()
    assert {(r["group_size"], r["kept"]): r["count"] for r in found} == {(15000, True): 1, (15000, False): 14999, (5, True): 3000, (5, False): 12000}


# 8


def test_classifier_generalises(spark):
    rng = np.random.default_rng(2)
    good, bad = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)], ["XX!!", "$$$", "Y|Z"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 60))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, ""), (1001, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    found = quality_model.classify(docs, labels).collect()
    assert len(found) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95


def test_classifier_by_brute_force(spark):
    """Features, ridge, cross-fitted scores, isotonic step and final scores, all made anew row by row."""
    rng = np.random.default_rng(6)
    docs = [(i, " ".join("".join(rng.choice(list("abcde!#1 \n") if i % 3 else list("XY|z%"), int(rng.integers(1, 9)))) for _ in range(int(rng.integers(0, 80))))) for i in range(240)]
    labels = [(i, int(i % 3 > 0 or i % 7 == 0), 0) for i in range(0, 240, 2)] + [(4, 1, 0)]
    found = {r.doc_id: r for r in quality_model.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = {}
    for d, t in docs:
        c = dict(zip(NAMES, stats(t), strict=True))
        words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
        root = lambda a, b: math.sqrt(min(a / b, 4))
        x[d] = [math.log(1 + c["n_words"]), min(chars / words, 30), min(math.sqrt(max(c["sum_squares"] / words - (chars / words) ** 2, 0)), 30), root(c["n_symbols"], words), root(c["n_dup_lines"], lines), root(c["n_distinct"], words), root(c["n_repeat_words"], words), root(c["n_upper"], chars), root(c["n_digits"], chars), root(c["n_marks"], words), root(c["n_stops"], words), math.log(1 + c["longest"]), root(c["most_frequent"], words), math.log(1 + words / lines), root(c["n_wide"], chars)]
    train = [(d, y, zlib.crc32(f"fold{d}".encode()) % 2) for d, y, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    X = np.array([x[d] for d, _, _ in train])
    mean, scale = X.mean(0), np.sqrt(np.maximum((X**2).mean(0) - X.mean(0) ** 2, 1e-6))
    draw, k = np.random.default_rng(5), quality_model.FEATURES
    w, phase = draw.normal(size=(15, k)) / np.sqrt(15), draw.uniform(0, 2 * np.pi, k)
    feature = lambda v: np.append(np.cos(np.clip((np.array(v) - mean) / scale, -6, 6) @ w + phase) * np.sqrt(2 / k), 1)

    def ridge(rows):
        z, y = np.array([feature(x[d]) for d, _, _ in rows]), np.array([y for _, y, _ in rows])
        lam = (1e-3 * len(rows) + 1e-6) * np.diag([*[1.0] * k, 1e-6])
        return np.linalg.inv(z.T @ z + lam) @ z.T @ y

    by_fold = [ridge([t for t in train if t[2] != f]) for f in (0, 1)]
    whole, bins = ridge(train), defaultdict(list)
    for d, y, f in train:
        raw = float(feature(x[d]) @ by_fold[f])
        bins[round((min(max(raw, -0.5), 1.5) + 0.5) / 2 * 1023)].append(y)
    blocks = [[b / 1023 * 2 - 0.5, len(ys), sum(ys)] for b, ys in sorted(bins.items())]
    while True:  # pool any two neighbours that are out of order
        at = next((i for i in range(len(blocks) - 1) if blocks[i][2] / blocks[i][1] >= blocks[i + 1][2] / blocks[i + 1][1]), None)
        if at is None:
            break
        (p, n, s), (q, m, r) = blocks[at : at + 2]
        blocks[at : at + 2] = [[(p * n + q * m) / (n + m), n + m, s + r]]
    for d, _ in docs:
        score = np.interp(feature(x[d]) @ whole, [b[0] for b in blocks], [b[2] / b[1] for b in blocks])
        assert found[d].score == pytest.approx(score, abs=1e-6) and found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert len({round(r.score, 3) for r in found.values()}) > 5


def test_classifier_of_nothing(spark, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(none, labels).count() == 0


def test_classifier_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.classify(odd, labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], labels.schema)
    assert quality_model.classify(odd, one).count() == odd.count()


def test_isotonic_is_monotone():
    at, mean = quality_model.isotonic([(0.0, 2, 2), (0.1, 1, 0), (0.2, 4, 1), (0.3, 1, 1)])
    assert (np.diff(mean) > 0).all() and (np.diff(at) > 0).all()


# 9


def brute_counts(text):
    words = WORDS.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t  #|é", max_size=80))
def test_counts(text):
    made = dict(zip(NAMES, stats(text), strict=True))
    assert tuple(made[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(text)


def test_rules(spark, odd, none):
    found = quality_rules.quality_rules(odd).collect()
    want = Counter((d, *brute_counts(t)) for d, t in pairs(odd))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    assert quality_rules.quality_rules(none).count() == 0


def test_rules_adapt(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    text = lambda w, n=80: " ".join(rng.choice(w, n))
    rows = [(i, text(words), "en", "plain") for i in range(150)] + [(200 + i, text([w + "#" for w in words]), "en", "marked") for i in range(150)]
    rows += [(400, text([w + "#" for w in words]), "en", "plain")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[400] and all(v for k, v in kept.items() if k != 400)


# 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cn", "Cs")), max_size=40) | st.text(alphabet="a's'tlrevmd  \n 1é日!", max_size=40), max_size=5))
def test_pretokens_match_the_pattern(texts):
    index, distinct, counts = pretokens.words(texts)
    words, at = pretokens.as_bytes(distinct), 0
    for t, n in zip(texts, counts, strict=True):
        assert [words[k].decode() for k in index[at : at + n]] == regex.findall(public_tokenizers.PATTERN, t)
        at += n


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_whole_texts(text):
    data = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = RANKS.setdefault("multi", pretokens.ranks_of_tiktoken(data))
    own = RANKS.setdefault("own", tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    index, distinct, _ = pretokens.words([text])
    words = pretokens.as_bytes(distinct)
    assert [i for k in index for i in own._core_bpe.encode_single_piece(words[k])] == own.encode_ordinary(text)


RANKS: dict = {}


def test_bpe_round_trip(spark, odd, none, monkeypatch):
    monkeypatch.setattr(bpe_words, "BLOCK_BYTES", 100_000)
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe_words.encode(odd, vocabulary)
    found = bpe_words.decode(made, vocabulary, keep=("doc_id", "n_tokens")).collect()
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    want = Counter((d, np.array(own.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in pairs(odd))
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    assert bpe_words.encode(none, vocabulary).count() == 0


def test_integers_pack():
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (bpe_words.unpack(bpe_words.pack(x)) == x).all()


# the queries over whole tables


@pytest.fixture(scope="module")
def asked():
    from galley.llm.queries import QUERIES

    return lambda spark, name: [r for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()]


def test_query_of_secrets(spark, asked):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    owners, repos = defaultdict(set), defaultdict(set)
    for d in docs:
        for *_, value in secret_scan.scan(d.text or ""):
            owners[value].add(d.source)
            repos[value].add(d.doc_id)
    looks_live = {v: len(o) < 2 or (len(o) < 3 and len(repos[v]) < 10) for v, o in owners.items()}
    want = Counter()
    for d in docs:
        spans = [x for x in secret_scan.scan(d.text or "") if x[2] < 3 or looks_live[x[3]]]
        live = sum(looks_live[x[3]] for x in spans)
        want[d.doc_id, *brute_secrets(d.text or ""), secret_scan.span_text(spans), live, len(spans) - live] += 1
    assert Counter(tuple(r) for r in asked(spark, "op2_secret_scan")) == want


def test_query_of_chats(spark, asked):
    turns = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    found = {r.conv_id: r for r in asked(spark, "op3_chat_format")}
    assert set(found) == set(turns)
    for k, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (found[k].n_turns, found[k].turns_sha256, found[k].loss_chars, found[k].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query_of_shards(spark, asked):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = Counter((d.doc_id, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.text_crc32) for r in asked(spark, "op4_external_shuffle")) == want
