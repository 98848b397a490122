"""Quality rules with adaptive thresholds (native DataFrame and SQL functions only).

Every document gets its measures from its whole text in one narrow pass (no shuffle).
The measures of each language and source go into mergeable quantile sketches: buckets
of geometrically growing width (relative error ``ACCURACY``), kept as plain counts per
(lang, source, measure, bucket).  Counts add up, so sketches of partitions, days or
shards merge by summing, a hot source is pre-aggregated before the shuffle, and results
don't depend on the order of merging.  Fences are read off the sketches and joined back.

A fence lies beyond the third quartile by ``reach`` times what lies between it and the
median (on a log scale), so it follows each source's own level and spread; three quarters
of a source must be junk of one kind before its median is junk, a quarter before its third
quartile is.  Small sources borrow from their language: its sketch counts as ``PRIOR``
documents more.  Shares are taken with some imagined clean words or lines added, so that a
short text's few marks don't look like a habit, and so that no value is zero.  The only
fixed limit is ``least``, the least spread (in buckets), for sources whose documents are
all alike.

Null or empty text: zero words, so the base rule rejects it.  Null lang or source: a
group of its own.  Repeated rows are judged alike, one by one; an empty table gives an
empty result; other columns are ignored (or kept, in :func:`filter_documents`).  Five-word
windows are compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, text_or_empty

BLANK = r"[\x20\x09-\x0D]+"
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Documents as which the sketch of its language counts in each source.
PRIOR = 50


@dataclass(frozen=True)
class Measure:
    """reach: how far beyond a quartile, in its ratios to the median, values still pass.
    least: the least such ratio, in buckets.  low: whether too small a value also fails."""

    value: str
    reach: int
    least: int
    low: bool = False


MEASURES = {
    "word_length": Measure("(word_chars + 100) / (n_words + 20)", 10, 1, True),
    "symbols": Measure("(n_symbols + 1) / (n_words + 50)", 4, 5),
    "dup_lines": Measure("(n_dup_lines + 1) / (n_lines + 5)", 4, 5),
    "capitals": Measure("(n_capitals + 1) / (word_chars + 100)", 8, 5),
}

#: Windows of five words that occur twice: sort (hash, place), keep places whose neighbour
#: has the same hash, and add up what each window adds beyond the one before it.
REPEATS = """
element_at(transform(array(sort_array(transform(__h, (x, i) -> struct(x as h, i as p)))), s ->
  element_at(transform(array(array_sort(transform(
      filter(sequence(0, size(s) - 1), j -> (j > 0 and s[j].h = s[greatest(j - 1, 0)].h)
                                         or (j < size(s) - 1 and s[j].h = s[least(j + 1, size(s) - 1)].h)),
      j -> s[j].p))), q ->
    aggregate(sequence(0, size(q) - 1), 0L,
      (n, j) -> n + if(j = size(q) - 1, 5, least(5, q[least(j + 1, size(q) - 1)] - q[j])))), 1)), 1)
"""


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of each whole text; no shuffle."""
    text = text_or_empty()
    kept = [F.col(c) for c in keep]
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *kept,
        words.alias("__w"),
        lines.alias("__l"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    second = first.select(
        *kept,
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("""element_at(transform(array(__w), w -> if(size(w) < 5, cast(array() as array<bigint>),
            transform(sequence(0, greatest(size(w), 5) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))), 1)""").alias("__h"),
    )
    return second.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(f"if(size(array_distinct(__h)) = size(__h), 0L, {REPEATS})").alias("n_repeat_words"),
        "n_lines",
        "n_capitals",
    )


def base_failed():
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _group(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00"))


def _bucket(m: Measure) -> str:
    return f"cast(ceil(ln(cast({m.value} as double)) / {math.log(GAMMA)!r}d) as bigint)"


def sketches(stats: DataFrame) -> DataFrame:
    """Mergeable sketches: (g_lang, g_source, measure, bucket, n), from rows that pass the base rule."""
    cells = ", ".join(f"struct('{k}' as measure, {_bucket(m)} as bucket)" for k, m in MEASURES.items())
    return (
        stats.where(~base_failed())
        .select(_group("lang").alias("g_lang"), _group("source").alias("g_source"), F.expr(f"inline(array({cells}))"))
        .groupBy("g_lang", "g_source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (g_lang, g_source): the lowest and highest bucket of each measure that passes.

    A source's cells count n times its language's documents and the language's cells
    ``PRIOR`` times n, so that weights are whole numbers.  ``sketch`` is read three times.
    """
    key = ["g_lang", "g_source", "measure"]
    lang = sketch.groupBy("g_lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    size = sketch.groupBy("g_lang", "measure").agg(F.sum("n").alias("size"))
    whole = lambda c: f"cast({c} as decimal(18, 0))"
    own = sketch.join(size, ["g_lang", "measure"]).select(*key, "bucket", F.expr(f"{whole('n')} * {whole('size')}").alias("w"))
    lent = sketch.select(*key).distinct().join(lang, ["g_lang", "measure"]).select(*key, "bucket", F.expr(f"{whole('n')} * {whole(PRIOR)}").alias("w"))
    cells = own.unionByName(lent).groupBy(*key, "bucket").agg(F.sum("w").alias("w"))
    ranked = cells.withColumn("cum", F.expr(f"sum(w) over (partition by {', '.join(key)} order by bucket)")).withColumn(
        "total", F.expr(f"sum(w) over (partition by {', '.join(key)})")
    )
    quart = ranked.groupBy(*key).agg(*[F.expr(f"min(bucket) filter (where cum * 4 >= total * {q})").alias(f"q{q}") for q in (1, 2, 3)])
    out = []
    for k, m in MEASURES.items():
        at = f"filter (where measure = '{k}')"
        out.append(F.expr(f"max(q3 + {m.reach} * greatest(q3 - q2, {m.least})) {at}").alias(f"hi_{k}"))
        if m.low:
            out.append(F.expr(f"max(q1 - {m.reach} * greatest(q2 - q1, {m.least})) {at}").alias(f"lo_{k}"))
    return quart.groupBy("g_lang", "g_source").agg(*out)


def judge(stats: DataFrame, fence: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept; ``fence`` has one row per language and source."""
    tests = []
    for k, m in MEASURES.items():
        tests.append(f"coalesce({_bucket(m)} > hi_{k}, false)")
        if m.low:
            tests.append(f"coalesce({_bucket(m)} < lo_{k}, false)")
    cols = stats.columns
    fence = fence.select(F.col("g_lang").alias("__gl"), F.col("g_source").alias("__gs"), *[c for c in fence.columns if c[:3] in ("hi_", "lo_")])
    joined = stats.withColumns({"__l": _group("lang"), "__s": _group("source")}).join(fence, (F.col("__l") == F.col("__gl")) & (F.col("__s") == F.col("__gs")), "left")
    return joined.select(*cols, base_failed().alias("base_failed"), (~base_failed() & ~F.expr(" or ".join(tests))).alias("kept"))


def _fence_table(stats: DataFrame) -> DataFrame:
    table = scratch(fences(scratch(sketches(stats), "quality-sketches")), "quality-fences")
    return small(table, table.count())


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept."""
    stats = scratch(measures(docs, "doc_id", "lang", "source"), "quality-measures")
    return judge(stats, _fence_table(stats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are measured once, written next to their measures and read again for the verdict:
    they aren't shuffled.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "lang", "source", "text")
    stats = scratch(measures(row, "__row", "lang", "source"), "quality-documents")
    judged = judge(stats, _fence_table(stats.drop("__row")))
    return judged.where("kept").select("__row.*")
