"""Line search with context windows over several sources, and response budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONTEXT = 3
#: Sources in their order of priority.
DOCS, SUMMARIES, COMMENTS = 0, 1, 2
DEFAULT_BUDGET, HARD_CAP = 12_000, 32_000


def context_windows(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text", around: int = CONTEXT) -> DataFrame:
    """(doc_id, first, last, hits, snippet): lines within ``around`` of a hit, windows that overlap or touch as one.

    Windows are merged within each row by folding over its hits in order, so nothing is shuffled.
    """
    low = query.lower()
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.col(text), "\n").alias("l")).where(F.exists("l", lambda x: F.lower(x).contains(low)))
    hits = F.filter(F.transform("l", lambda x, i: F.when(F.lower(x).contains(low), i + 1)), lambda i: i.isNotNull())
    spans = lines.select("doc_id", "l", hits.alias("h")).withColumn(
        "spans",
        F.expr(
            f"""aggregate(h, cast(array() as array<struct<first: int, last: int, hits: int>>), (a, i) ->
            if(size(a) > 0 and i - {around} <= element_at(a, -1).last + 1,
               concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).first as first, i + {around} as last, element_at(a, -1).hits + 1 as hits))),
               concat(a, array(struct(i - {around} as first, i + {around} as last, 1 as hits)))))"""
        ),
    )
    each = spans.select("doc_id", "l", F.explode("spans").alias("s"))
    first, last = F.greatest(F.col("s.first"), F.lit(1)), F.least(F.col("s.last"), F.size("l"))
    return each.select("doc_id", first.alias("first"), last.alias("last"), F.col("s.hits").alias("hits"), F.array_join(F.slice("l", first, last - first + 1), "\n").alias("snippet"))


def search_all(docs: DataFrame, files: DataFrame, symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(source, place, snippet): document lines first, then file summaries, then doc comments."""
    low = query.lower()
    doc = context_windows(docs, query).select(F.lit(DOCS).alias("source"), F.concat_ws(":", "doc_id", "first").alias("place"), "snippet")
    said = F.coalesce("llm_description", "detailed_purpose", "purpose")
    summary = files.where(F.lower(said).contains(low)).select(F.lit(SUMMARIES).alias("source"), F.col("path").alias("place"), said.alias("snippet")).orderBy("place").limit(limit)
    comment = symbols.where(F.lower("jsdoc").contains(low)).select(F.lit(COMMENTS).alias("source"), F.col("qualified_name").alias("place"), T.doc_first_line(F.col("jsdoc")).alias("snippet")).orderBy("place").limit(limit)
    one = doc.unionByName(summary).unionByName(comment)
    first = one.groupBy("snippet").agg(F.min(F.struct("source", "place")).alias("b"))
    return first.select("b.source", "b.place", "snippet").orderBy("source", "place")


def within_budget(sections: Column, budget: int = DEFAULT_BUDGET) -> Column:
    """Which sections of one response fit.

    sections: array<struct<priority, ord, bytes>>.  By priority, then place, a section is taken
    if it still fits; one that doesn't is skipped, and later ones may still fit.  Returns the
    ``ord`` of those taken.
    """
    budget = min(budget, HARD_CAP)
    taken = F.aggregate(
        F.array_sort(F.transform(sections, lambda s: F.struct(s["priority"].cast("int").alias("priority"), s["ord"].cast("int").alias("ord"), s["bytes"].cast("long").alias("bytes")))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken")),
        lambda a, s: F.when(
            a["used"] + s["bytes"] <= budget,
            F.struct((a["used"] + s["bytes"]).alias("used"), F.concat(a["taken"], F.array(s["ord"])).alias("taken")),
        ).otherwise(F.struct(a["used"].alias("used"), a["taken"].alias("taken"))),
    )
    return taken["taken"]


def snippet(content: Column, line: Column, n: int = 15) -> Column:
    """``n`` lines from a 1-based line on."""
    return F.array_join(F.slice(F.split(content, "\n"), line, n), "\n")
