"""Incremental maintenance: changed rows, key merges, deletions that leave no references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import invert_calls


def changed(current: DataFrame, cached: DataFrame, key: str = "path", hash_: str = "content_hash") -> DataFrame:
    """(key, state) of rows that are new or whose hash differs; a null hash counts as different from any other."""
    old = cached.select(F.col(key).alias("__k"), F.col(hash_).alias("__h"))
    joined = current.join(old, F.col(key) == F.col("__k"), "left").where(F.col("__k").isNull() | ~F.col(hash_).eqNullSafe(F.col("__h")))
    return joined.select(key, F.when(F.col("__k").isNull(), "new").otherwise("changed").alias("state"))


def deleted(current: DataFrame, cached: DataFrame, key: str = "path") -> DataFrame:
    return cached.select(key).join(current.select(key), key, "left_anti")


def merge(base: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """Rows of ``base`` whose keys are neither replaced nor gone, and the new rows."""
    out = new.select(*keys).distinct()
    out = out.unionByName(gone.select(*keys)).distinct() if gone is not None else out
    return base.join(out, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """Symbols without those of gone files (column file), and without calls to or from them.

    Removed names are joined to the exploded references, so no list of them is collected.
    """
    removed = symbols.join(gone.select("file").distinct(), "file", "left_semi").select(F.col("qualified_name").alias("ref"))
    left = symbols.join(gone.select("file").distinct(), "file", "left_anti")

    def clean(column: str) -> DataFrame:
        refs = left.select("qualified_name", F.posexplode(column).alias("pos", "ref"))
        kept = refs.join(removed, "ref", "left_anti").groupBy("qualified_name")
        return kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias(f"__{column}"))

    none = F.array().cast("array<string>")
    out = left.join(clean("calls"), "qualified_name", "left").join(clean("called_by"), "qualified_name", "left")
    return out.withColumns({"calls": F.coalesce("__calls", none), "called_by": F.coalesce("__called_by", none)}).select(*symbols.columns)


def apply_changes(symbols: DataFrame, changed_symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """Symbols after a batch: rows of gone and changed files out, new rows in, callers inverted once."""
    files = changed_symbols.select("file").unionByName(gone.select("file")).distinct()
    new = symbols.join(files, "file", "left_anti").unionByName(changed_symbols, allowMissingColumns=True)
    calls = new.select(F.col("qualified_name").alias("caller"), F.explode("calls").alias("callee"))
    callers = invert_calls(calls, new).select(F.col("callee").alias("qualified_name"), F.col("called_by").alias("__called_by"))
    known = calls.join(new.select(F.col("qualified_name").alias("callee")), "callee", "left_semi").groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("__calls"))
    none = F.array().cast("array<string>")
    out = new.join(callers, "qualified_name", "left").join(known.withColumnRenamed("caller", "qualified_name"), "qualified_name", "left")
    return out.withColumns({"called_by": F.coalesce("__called_by", none), "calls": F.coalesce("__calls", none)}).select(*symbols.columns)


def last_events(events: DataFrame, key: str = "path", op: str = "op", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, op, ts): the last event of each key wins; ties by ``tie``."""
    best = events.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(op).alias("op"))).alias("b"))
    return best.select(key, "b.op", "b.ts")


def misses(files: DataFrame, memo: DataFrame) -> DataFrame:
    """Files whose (path, hash) has no summary yet."""
    return files.join(memo.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def symbol_tests(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, test): by the test file's name, or because it imports the source."""
    from ..functions import text as T

    tests = files.where(T.is_test(F.col("path"))).select(F.col("path").alias("test"))
    sources = files.where(~T.is_test(F.col("path"))).select(F.col("path").alias("source"))
    named = tests.select("test", F.explode(T.test_sources(F.col("test"))).alias("source")).join(sources, "source", "left_semi")
    used = imports.select(F.col("file").alias("test"), F.col("dep").alias("source")).join(tests, "test", "left_semi").join(sources, "source", "left_semi")
    return named.select("source", "test").union(used.select("source", "test")).distinct()
