"""Queries of the training-data operators over whole tables, and their SQL where there is one (``sql.py``)."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tables
from .vocabulary import Vocabulary


def op1_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    (docs,) = tables(spark, sf_dir, "documents")
    return near_duplicates(docs, ngram=3, radius=3)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    (docs,) = tables(spark, sf_dir, "documents")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind_name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return secret_scan(docs, owner=F.col("source"), example_owners=3).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "n_live", "n_example")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, loss_text, read_turns

    (chats,) = tables(spark, sf_dir, "conversations")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    made = format_chats(chats.select("conv_id", "turn", "role", "text").unionByName(extra))
    back = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffle_shards

    (docs,) = tables(spark, sf_dir, "documents")
    placed = shuffle_shards(docs, shards=16, seed=11)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    (docs,) = tables(spark, sf_dir, "documents")
    packed = pack(docs, Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    (pages,) = tables(spark, sf_dir, "pages")
    return archive(pages)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    (docs,) = tables(spark, sf_dir, "documents")
    return exact_dedup(docs, keep="largest")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify

    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return classify(docs, labels)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    (docs,) = tables(spark, sf_dir, "documents")
    return quality_rules(docs).drop("broken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_words import decode, encode

    (docs,) = tables(spark, sf_dir, "documents")
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = decode(encode(docs, vocabulary), vocabulary, keep=("doc_id", "n_tokens"))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    (vectors,) = tables(spark, sf_dir, "embeddings")
    return top_k(vectors, queries=F.col("vec_id") % 50 == 0, k=5, scale=256)


def _replanted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document, by a hash, the words from some place on are repeated with a period."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    made = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    made = made.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    made = made.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return made.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    (docs,) = tables(spark, sf_dir, "documents")
    found = periodic_runs(_replanted(docs), least=24, exponent=3)
    more = "cast(l.length as decimal(19)) * r.period"
    less = "cast(r.length as decimal(19)) * l.period"
    first = F.expr(f"array_sort(runs, (l, r) -> case when {more} > {less} then -1 when {more} < {less} then 1 when l.start <> r.start then if(l.start < r.start, -1, 1) else if(l.period < r.period, -1, 1) end)[0]")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, first).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"), F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    (vectors,) = tables(spark, sf_dir, "embeddings")
    return whiten(vectors, components=16, scale=64, offset=1_000_000)


QUERIES = {f.__name__: f for f in (op1_simhash_bk_trees, op2_secret_scan, op3_chat_format, op4_external_shuffle, op5_best_fit_packing, op6_arc_to_warc, op7_exact_dedup, op8_quality_classifier, op9_quality_rules, op10_byte_bpe, op11_pivot_top_k, op12_periodic_runs, op13_whitening)}
