"""Secret scan: credential patterns, and how widely each candidate is copied over the corpus.

Every whole text is scanned for the base kinds and for high-entropy tokens.  A candidate's value is hashed, and hashes
are counted by distinct repositories and owners.  What many owners have is a copied example, and so is what several
owners have in many repositories; what one owner has looks live, in however many of its repositories.  Base spans always
stay; a token's span is reported only if it looks live.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import as_array, by_group, materialize, sub_batches, texts, tidied

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
WORD = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bytes of what ``redact`` is told of live spans up to which it is broadcast; beyond, texts are joined by a shuffle.
TOLD_BYTES = 32 << 20
_SPAN = "start: long, stop: long, kind: int, hash: string"


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def scan(text: str, token_entropy: float = 3.5) -> list[tuple[int, int, int, str]]:
    """(start, stop, kind, value) by start, then kind; offsets are code points, ``stop`` exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in WORD):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= token_entropy and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            found.append((m.start(), m.end(), 3, v))
    return sorted(found)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in spans)


def _findings(df: DataFrame, id_col: str, text_col: str, repo, owner) -> DataFrame:
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.xxhash64(text_col).alias("text_key"))
    schema = f"rid long, doc_id long, text_key long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<{_SPAN}>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("hash", pa.string())]))

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in (x for b in batches for x in sub_batches(b, "text")):
            n = batch.num_rows
            spans, counts, digest = [], ([], [], []), []
            for t in texts(batch.column(1)):
                own = scan(t)
                base = [x for x in own if x[2] < 3]
                for k in range(3):
                    counts[k].append(sum(x[2] == k for x in base))
                digest.append(hashlib.sha256(span_text(base).encode()).hexdigest())
                spans.append([{"start": s, "stop": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in own])
            cols = [pa.array(np.arange(rid, rid + n)), batch.column(0), batch.column(4), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), as_array(spans, span)]
            rid += n
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "text_key", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_copies) of candidates (hash, owner, repo); a repository is counted within its owner.

    A missing owner or repository counts as one of its own.
    """
    known = candidates.select("hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    by_owner = known.groupBy("hash", "owner", "repo").agg(F.count("*").alias("c")).groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.sum("c").alias("n_copies"))


def is_example(example_owners: int, example_repos: int):
    """Whether a candidate with ``n_owners`` and ``n_repos`` is a copied example."""
    return (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo=None, owner=None, example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """One row per input row: (doc_id, text_key, n_assign, n_access, n_hex, base_sha256, n_live, n_example, spans).

    ``spans``: array of (start, stop, kind, kind_name, live, n_owners, n_repos), ordered by start, then kind.  ``repo``
    and ``owner`` are columns, by default each document and its ``source``.  A candidate that ``example_owners`` owners
    or more have, or two or more in ``example_repos`` repositories or more, is an example, else it looks live.  Null
    texts count as empty; rows keep their number; an empty table gives no row; other columns are ignored.
    """
    repo = F.col(id_col) if repo is None else repo
    owner = (F.col("source") if "source" in df.columns else F.lit(None)) if owner is None else owner
    found = materialize(_findings(df, id_col, text_col, repo, owner), "findings")
    each = found.where(F.size("spans") > 0).select("rid", "repo", "owner", F.explode("spans").alias("s")).select("rid", "repo", "owner", "s.*")
    known = materialize(ownership(each.select("hash", "owner", "repo")).withColumnRenamed("n_copies", "__n"), "ownership")
    live = ~is_example(example_owners, example_repos)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    judged = by_group(each, known, ["hash"]).where(live | (F.col("kind") < 3))
    span = F.struct("start", "kind", "stop", name.alias("kind_name"), live.alias("live"), "n_owners", "n_repos")
    by_row = judged.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("judged"))  # a text's own spans
    out = found.drop("spans", "repo", "owner").join(by_row, "rid", "left").withColumn("spans", F.coalesce("judged", F.array().cast(by_row.schema["judged"].dataType)))
    count = lambda want: F.size(F.filter("spans", lambda s: s["live"] == F.lit(want))).cast("long")
    return out.select("doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", count(True).alias("n_live"), count(False).alias("n_example"), "spans")


def redact(df: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """``df`` with the spans that look live replaced by ``mark`` in the text; copied examples and other texts stay.

    ``judged`` is ``secret_scan(df)``.  Overlapping spans are replaced as one.  Null texts stay null; all other columns
    stay as they are.  Texts meet their spans, which are few, by a broadcast of checked size, else by a shuffle.
    """
    cuts = judged.where("n_live > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.expr("transform(filter(spans, s -> s.live), s -> struct(s.start, s.stop))").alias("__cut"))
    cuts = materialize(cuts.dropDuplicates(["__id", "__key"]), "cuts")
    size = cuts.agg(F.sum(16 * F.size("__cut") + 64)).first()[0] or 0
    columns, text = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{text_col}`")
    cond = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key"))
    joined = df.join(F.broadcast(cuts) if size <= TOLD_BYTES else cuts, cond, "left")
    part = lambda a, b: F.substr(text, a + 1, b - a)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("stop"))
    step = lambda a, s: F.when(s["start"] >= a["stop"], F.struct(F.concat(a["out"], part(a["stop"].cast("int"), s["start"].cast("int")), F.lit(mark)).alias("out"), s["stop"].alias("stop"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["stop"], s["stop"]).alias("stop")))
    done = F.aggregate("__cut", zero, step)
    clean = F.when(F.col("__cut").isNull(), text).otherwise(F.concat(done["out"], part(done["stop"].cast("int"), F.length(text))))
    return joined.select(*[clean.alias(c) if c == text_col else x for c, x in zip(df.columns, columns, strict=True)])
