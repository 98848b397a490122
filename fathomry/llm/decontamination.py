"""Benchmark decontamination as a prefix-filtered set join (native functions only).

A benchmark item gives windows of ``WINDOW`` consecutive words (one shorter window if it
has fewer words).  A document holds a window only if it holds the window's rarest word, so
that word alone is the window's necessary prefix under the order "rarest first".  Rarity
is counted over the words of all documents.

The words of documents are joined to the distinct prefix words, each of which lists the
offsets and lengths of its windows: these bound where a window can lie, and only windows
that fit into the document are cut out, joined to the benchmark's windows by hash, and
compared word by word.  So a prefix word costs its offsets (36 at most), however many
windows begin with it.

The documents are read twice, once to count and once to search, whatever the benchmark's
size, and the plan doesn't grow with it.  Prefix words and windows are broadcast within
the bounds of ``tables.small``; beyond them they are joined by shuffle, with the fifteen
words around each place.  The shuffle by document carries hits and one row a document.

Null, empty or wordless texts: no words, no hits.  Every row gets a row, repeated ones too.
Items with one item_id and several texts count as one item.  Empty tables: no rows, or no
hits.  Null item_ids count as an item but have no place in the list.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, text_or_empty

WINDOW = 8
#: Hit words from which :func:`decontaminate` drops a document: one whole window.
LEAST_HIT = WINDOW
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased (and no other letters)."""
    cut = F.filter(F.split(text, BETWEEN_WORDS), lambda w: w != "")
    ascii_only = F.octet_length(text) == F.length(text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    small_case = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, upper, lower))
    return F.when(ascii_only, F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")).otherwise(F.transform(cut, small_case))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, ws): every window of every item, once per item."""
    w = benchmark.select("item_id", words(text_or_empty()).alias("__w")).where(F.size("__w") > 0)
    return w.select(
        "item_id",
        F.explode(F.expr(f"transform(sequence(0, greatest(size(__w) - {size}, 0)), i -> slice(__w, i + 1, {size}))")).alias("ws"),
    ).distinct()


def _broadcast(df: DataFrame) -> tuple[DataFrame, bool]:
    marked = small(df, df.count())
    return marked, marked is not df


def rarity(doc_words: DataFrame, bench: DataFrame) -> DataFrame:
    """(h, n): how often each word of the windows (by hash) occurs in all documents."""
    own = scratch(bench.select(F.explode("ws").alias("w")).select(F.xxhash64("w").alias("h")).distinct(), "decontamination-vocabulary")
    each = doc_words.select(F.explode("__w").alias("w")).select(F.xxhash64("w").alias("h"))
    own, fits = _broadcast(own)
    if fits:
        return each.join(own, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(own, "h", "left_semi")


def prefixes(doc_words: DataFrame, bench: DataFrame) -> DataFrame:
    """(item_id, ws, h, offset): each window with its rarest word's hash and place.

    A window with a word that no document has can't occur and is left out.
    """
    counts = scratch(rarity(doc_words, bench), "decontamination-rarity")
    each = bench.select("item_id", "ws", F.posexplode("ws").alias("offset", "w")).withColumn("h", F.xxhash64("w"))
    return (
        each.join(_broadcast(counts)[0], "h", "left")
        .groupBy("item_id", "ws")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("p"))
        .where("p.n > 0")
        .select("item_id", "ws", "p.h", "p.offset")
    )


def _candidates(doc_words: DataFrame, prefix: DataFrame) -> DataFrame:
    """(doc_id, __tag, __row, n_words, p, start, ws): windows of documents that lie around a prefix word.

    Every document also has a row with p = 0: a blank word stands before its first one, and
    the blank is a prefix word too.
    """
    at = F.struct("offset", F.size("ws").alias("len"))
    heads = prefix.groupBy("h").agg(F.collect_set(at).alias("at"))  # at most 36 for each
    blank = prefix.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.expr("array(struct(0 as offset, 0 as len))").alias("at"))
    heads, fits = _broadcast(scratch(heads.unionByName(blank), "decontamination-heads"))
    seen = doc_words.select("*", F.size("__w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "__w")).alias("p", "w"))
    if fits:  # the document's words stay where they are
        near = seen.withColumn("base", F.lit(0))
    else:
        r = WINDOW - 1
        near = seen.withColumn("base", F.expr(f"greatest(p - 1 - {r}, 0)")).withColumn("__w", F.expr(f"slice(__w, base + 1, {2 * r + 1})"))
    met = near.withColumn("h", F.xxhash64("w")).join(heads, "h").select("doc_id", "__tag", "__row", "n_words", "p", "base", "__w", F.explode("at").alias("c"))
    inside = met.where("p = 0 or (p - 1 >= c.offset and p - 1 - c.offset + c.len <= n_words)").withColumn("start", F.expr("p - 1 - c.offset"))
    return inside.select("doc_id", "__tag", "__row", "n_words", "p", "start", F.expr("slice(__w, greatest(start - base, 0) + 1, c.len)").alias("ws"))


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and __tag)."""
    doc_words = docs.select("doc_id", F.xxhash64("text").alias("__tag"), F.monotonically_increasing_id().alias("__row"), words(text_or_empty()).alias("__w"))
    bench = scratch(windows(benchmark), "decontamination-windows")
    prefix = scratch(prefixes(doc_words.select("__w"), bench), "decontamination-prefix")
    known = _broadcast(prefix.select("item_id", F.col("ws").alias("bs")))[0].withColumn("bh", F.xxhash64("bs"))
    met = _candidates(doc_words, prefix).withColumn("wh", F.xxhash64("ws")).join(known, (F.col("wh") == F.col("bh")) & (F.col("ws") == F.col("bs")), "left")
    held = F.col("bs").isNotNull()
    hits = met.where(held | (F.col("p") == 0)).select(
        "doc_id",
        "__tag",
        "__row",
        "n_words",
        F.when(held, F.struct("start", F.size("ws").alias("len"))).alias("hit"),
        F.when(held, F.struct("item_id")).alias("item"),
    )
    found = hits.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("__tag").alias("__tag"),
        F.first("n_words").cast("long").alias("n_words"),
        F.collect_set("hit").alias("hits"),
        F.collect_set("item").alias("items"),
    )
    covered = (
        "if(size(hits) = 0, 0L, element_at(transform(array(array_sort(hits)), h -> aggregate(h, struct(0L as n, 0L as upto),"
        " (a, x) -> struct(a.n + greatest(x.start + x.len - greatest(a.upto, cast(x.start as bigint)), 0L) as n,"
        " greatest(a.upto, cast(x.start + x.len as bigint)) as upto), a -> a.n)), 1))"
    )
    ids = F.array_sort(F.transform(F.filter("items", lambda x: x["item_id"].isNotNull()), lambda x: x["item_id"].cast("string")))
    return found.select(
        "doc_id",
        "__tag",
        "n_words",
        F.expr(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_hit: int = LEAST_HIT) -> DataFrame:
    """The documents with fewer than ``least_hit`` words in benchmark windows, with their own columns.

    One passage of one item is enough (the flag of :func:`contamination` asks for two items).
    An item shorter than ``least_hit`` words doesn't drop a document by itself: a few words in
    a row occur by chance.  The ids of dropped documents (few of all) are joined back; texts
    are shuffled only if those ids are too many to broadcast.
    """
    bad = scratch(contamination(docs, benchmark).where(F.col("n_hit") >= least_hit).select(F.col("doc_id").alias("__id"), "__tag").distinct(), "decontamination-bad")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tag"))
    return docs.join(small(bad, bad.count()), on, "left_anti")
