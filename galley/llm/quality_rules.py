"""Quality rules whose cutoffs come from mergeable quantile sketches of each language and source.

A sketch counts the values of a metric by their six leading bits, so that sketches merge by adding counts, exactly, and
a quantile is known to a thirty-second of its value.  The sketches of a source merge into those of a language and of
the corpus.  A group's quartiles are blended with those of the level above it by numbers of documents, so that small groups
lean on it and none changes its cutoffs at once.  The least spread of a metric is a quartile too: of what one item more adds
to a document's value, which is much for short documents and little for long ones.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, materialize
from .docstats import with_stats

#: metric: (numerator, denominator, factor, items): integers, factor * numerator div denominator; ``items`` more of the numerator
#: are one thing more to the reader (three places of a three-word window, where repeated words are counted).
METRICS = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "word_length": ("word_chars", "n_words", 100, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 9),
    "capitals": ("n_upper", "word_chars", 1000, 1),
    "marks": ("n_marks", "n_words", 1000, 1),
}
#: Spreads beyond a quartile at which a cutoff is, and documents that the level above a group counts for.
SPREADS, WEIGHT = 8, 10


def failing(min_words: int = 50, most_repeats: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, value, n): how many documents of a language and source have a value of a metric.

    ``<metric>_item`` is what one item more adds to a document's value of the metric.
    """
    parts = [(m, f"{k} * {a} div {b}") for m, (a, b, k, _) in METRICS.items()] + [(f"{m}_item", f"{k * more} div {b}") for m, (_, b, k, more) in METRICS.items()]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.expr(f"cast({v} as bigint)"), F.lit(0)).alias("v")) for m, v in parts])
    rows = stats.select("lang", "source", F.explode(each).alias("m")).select("lang", "source", "m.*")
    drop = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    value = F.expr("shiftleft(shiftright(v, cut), cut)")
    return rows.withColumn("cut", drop).withColumn("value", value).groupBy("lang", "source", "metric", "value").agg(F.count("*").alias("n"))


#: The levels that sketches are merged at: a language's source, a language, the corpus.
LEVELS = (("lang", "source"), ("lang",), ())


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, n, q1, q3) of the sketches merged at all ``LEVELS``; columns that a level lacks are empty."""
    each = F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in by else F.lit("")).alias(c) for c in LEVELS[0]]) for k, by in enumerate(LEVELS)])
    group = ["level", "lang", "source", "metric"]
    merged = sketch.select(F.explode(each).alias("at"), "metric", "value", "n").select("at.*", "metric", "value", "n").groupBy(*group, "value").agg(F.sum("n").alias("n"))
    window = Window.partitionBy(*group)
    ranked = merged.withColumn("upto", F.sum("n").over(window.orderBy("value"))).withColumn("all", F.sum("n").over(window))
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("all"), F.col("value")))
    return ranked.groupBy(*group).agg(F.max("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def blended(q: DataFrame) -> DataFrame:
    """(lang, source, metric, q1, q3) of every language and source: its quartiles and those of its language, and these and the corpus's,
    weighed by their documents against ``WEIGHT``."""
    own, lang, whole = (q.where(F.col("level") == k).select(*by, "metric", F.struct("n", "q1", "q3").alias(f"l{k}")) for k, by in enumerate(LEVELS))
    met = own.join(lang.join(F.broadcast(whole), "metric"), ["lang", "metric"])  # the corpus has a row for each metric
    mix = lambda n, low, high: F.expr(f"({n} * {low} + {WEIGHT} * {high}) div ({n} + {WEIGHT})")
    for c in ("q1", "q3"):
        met = met.withColumn(f"up_{c}", mix("l1.n", f"l1.{c}", f"l2.{c}")).withColumn(c, mix("l0.n", f"l0.{c}", f"up_{c}"))
    return met.select("lang", "source", "metric", "q1", "q3")


def limits(found: DataFrame) -> DataFrame:
    """(lang, source, limits): a struct of cutoffs above ``q3 + SPREADS * spread``, for word length also below ``q1 - ...``."""
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    each = found.groupBy("lang", "source").agg(*[of(m, c).alias(f"{m}_{c}") for m in METRICS for c in ("q1", "q3")], *[of(f"{m}_item", "q3").alias(f"{m}_item") for m in METRICS])
    spread = {m: SPREADS * F.greatest(F.col(f"{m}_q3") - F.col(f"{m}_q1"), F.col(f"{m}_item")) for m in METRICS}
    parts = [x for m in METRICS for x in ((F.col(f"{m}_q1") - spread[m] if m == "word_length" else F.lit(-1)).alias(f"{m}_low"), (F.col(f"{m}_q3") + spread[m]).alias(f"{m}_high"))]
    return each.select("lang", "source", F.struct(*parts).alias("limits"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken).

    ``base_failed``: under 50 words, or over half of them in repeated three-word windows.  Sketches cover the documents
    that pass.  ``broken`` lists the metrics beyond their cutoffs; ``kept`` is true where none is and the base rules
    hold.  Null texts count as empty, null languages and sources as groups of their own.  Rows keep their number; an
    empty table gives no row; other columns are ignored.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    stats = materialize(with_stats(source, ("doc_id", "lang", "source")), "stats").withColumn("base_failed", failing())
    found = materialize(quartiles(sketches(stats.where(~F.col("base_failed")))), "quartiles")
    sized = stats.groupBy("lang", "source").agg(F.count("*").alias("__n"))
    groups = materialize(sized.join(limits(blended(found)), ["lang", "source"], "left"), "groups")
    judged = by_group(stats, groups, ["lang", "source"])
    value = {m: F.expr(f"cast({k} * {a} div {b} as bigint)") for m, (a, b, k, _) in METRICS.items()}
    broken = F.array_compact(F.array(*[F.when((v > F.col(f"limits.{m}_high")) | (v < F.col(f"limits.{m}_low")), F.lit(m)) for m, v in value.items()]))
    judged = judged.withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")
