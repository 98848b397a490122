"""Aggregations, dashboards, coverage and health."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def module_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(T.first_segment(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n"))


def index_summary(symbols: DataFrame, richness: str) -> DataFrame:
    """One row: files, symbols, counts by type as a map, and richness."""
    by = symbols.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    types = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("symbol_counts"))
    return symbols.agg(F.count_distinct("file").alias("file_count"), F.count(F.lit(1)).alias("symbol_count")).join(F.broadcast(types)).withColumn("richness", F.lit(richness))


def common_imports(files: DataFrame, module: str, n: int = 5) -> DataFrame:
    own = files.where(F.col("path").startswith(module + "/") | (F.col("path") == module))
    return own.select(F.explode("dependencies").alias("dep")).groupBy("dep").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dep").limit(n)


def role_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(T.role(F.col("path")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def file_complexity(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file").agg(F.sum("complexity").alias("complexity"))


def entry_points(symbols: DataFrame, n: int = 5) -> DataFrame:
    """Exported symbols by how many call them."""
    return symbols.where("is_exported").select("qualified_name", F.size("called_by").alias("callers")).orderBy(F.desc("callers"), "qualified_name").limit(n)


def structure(symbols: DataFrame) -> DataFrame:
    """One row of counts in one pass, the share exported, and the dominant style."""
    kind = F.col("type")
    named = F.col("name")
    one = symbols.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_exported") & (kind != "module-init")).alias("exported"),
        F.count_if(kind == "function").alias("functions"),
        F.count_if((kind == "function") & F.coalesce("is_async", F.lit(False))).alias("async_functions"),
        F.count_if(kind == "class").alias("classes"),
        F.count_if(kind == "interface").alias("interfaces"),
        F.count_if((named == "handler") | named.endswith("Handler") | named.startswith("handle")).alias("handlers"),
    )
    style = F.when(F.col("classes") > F.col("functions"), "class-based").when(F.col("functions") > 0, "functional")
    return one.withColumns({"percent_exported": F.floor(F.col("exported") / F.greatest("total", F.lit(1)) * 100 + 0.5).cast("long"), "style": style})


def label_counts(files: DataFrame) -> DataFrame:
    return files.select(F.explode(T.file_labels(F.col("path"), F.col("purpose"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Markers of data-access and styling libraries, first match wins.
ORMS = ("prisma", "typeorm", "sequelize", "mongoose", "drizzle", "knex", "sqlalchemy", "django.db")
STYLES = ("styled-components", "@emotion", "tailwind", "sass", "less", ".css")


def detected(dependencies: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """One row (found): the first marker that any dependency holds, else null."""
    flags = dependencies.agg(*[F.coalesce(F.max(F.lower("dep").contains(m)), F.lit(False)).alias(f"m{k}") for k, m in enumerate(markers)])
    found = F.coalesce(*[F.when(F.col(f"m{k}"), F.lit(m)) for k, m in enumerate(markers)])
    return flags.select(found.alias("found"))


def readiness(gaps: Column, stale: Column, errors: Column, richness: Column) -> Column:
    poor = F.when(richness == "minimal", 20).when(richness == "standard", 10).otherwise(0)
    return F.greatest(F.lit(0), 100 - F.least(gaps * 3, F.lit(30)) - F.least(stale * 2, F.lit(20)) - poor - F.least(errors * 5, F.lit(20)))


def coverage_gaps(on_disk: DataFrame, indexed: DataFrame, limit: int | None = 20) -> DataFrame:
    """Paths on disk that no indexed path equals, or ends with, or is an ending of.

    Both ways of ending share the last segment, so that is the join key.
    """
    disk = on_disk.select("path", T.base_name(F.col("path")).alias("base"))
    known = indexed.select(F.col("path").alias("k"), T.base_name(F.col("path")).alias("kbase"))
    fits = (F.col("base") == F.col("kbase")) & (
        (F.col("path") == F.col("k")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("k"))) | F.col("k").endswith(F.concat(F.lit("/"), F.col("path")))
    )
    gaps = disk.join(known, fits, "left_anti").select("path")
    return gaps.orderBy("path").limit(limit) if limit else gaps


def stale(files: DataFrame, built: Column) -> DataFrame:
    """Files modified after the build."""
    return files.where(F.col("modified") > built)


def is_stale(files: DataFrame, built: Column) -> DataFrame:
    return files.agg(F.coalesce(F.bool_or(F.col("modified") > built), F.lit(False)).alias("stale"))


def health(files: DataFrame, on_disk: DataFrame, built: Column, errors: int, richness: str) -> DataFrame:
    """One row: gaps, stale, errors, richness and the readiness score."""
    gaps = coverage_gaps(on_disk, files).agg(F.count(F.lit(1)).alias("gaps"))
    old = stale(on_disk, built).agg(F.count(F.lit(1)).alias("stale"))
    one = gaps.join(F.broadcast(old)).withColumns({"errors": F.lit(errors), "richness": F.lit(richness)})
    return one.withColumn("readiness", readiness(F.col("gaps"), F.col("stale"), F.col("errors"), F.col("richness")))


def module_table(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, files, exports, depends_on, dependents) of every module."""
    own = symbols.groupBy(T.first_segment(F.col("file")).alias("module")).agg(F.count_distinct("file").alias("files"), F.count_if("is_exported").alias("exports"))
    out = edges.groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    back = edges.groupBy(F.col("dst").alias("module")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    joined = own.join(out, "module", "left").join(back, "module", "left")
    return joined.withColumns({"depends_on": F.coalesce("depends_on", none), "dependents": F.coalesce("dependents", none)})


def embedding_cost(texts: DataFrame, price_per_million: float) -> DataFrame:
    """One row (chars, tokens, cost): four characters a token."""
    one = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    one = one.withColumn("tokens", F.ceil(F.col("chars") / 4))
    return one.withColumn("cost", F.col("tokens") * price_per_million / 1_000_000)


def distinct_throws(symbols: DataFrame) -> DataFrame:
    return symbols.select("file", F.explode("throws").alias("t")).groupBy("file").agg(F.array_sort(F.collect_set("t")).alias("throws"))


def public_api(symbols: DataFrame) -> DataFrame:
    """(file, exports, public_api) of exported symbols, by line."""
    rows = symbols.where("is_exported and type != 'module-init'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "name", "type", "signature", "jsdoc"))).alias("l"))
    return rows.select("file", F.transform("l", lambda x: x["name"]).alias("exports"), F.transform("l", lambda x: F.struct(x["name"], x["type"], x["signature"], x["jsdoc"])).alias("public_api"))


# The lines in which a build log reports its phases, with the numbers' names.
LOG_LINES = (
    "Symbols: {symbols} in {symbols_ms}ms",
    "Dependencies: {modules} modules?, {cycles} cycles? in {dependencies_ms}ms",
    "Summaries: {summaries} generated [(]{cached} cached[)] in {summaries_ms}ms",
    "Embeddings: {embedded_files} files?, {embedded_symbols} symbols? in {embeddings_ms}ms",
    "Graph: {nodes} nodes?, {edges} edges? in {graph_ms}ms",
    "Graphify: [+]{added_nodes} nodes?, [+]{added_edges} edges? in {graphify_ms}ms",
    "Features: {features} discovered in {features_ms}ms",
    "Done in {total_ms}ms total",
)


def log_stats(logs: DataFrame) -> DataFrame:
    """Numbers that build logs report by phase, null where they don't, and language_files: language -> files found."""
    out = []
    for line in LOG_LINES:
        pattern = re.sub(r"[{]\w+[}]", r"(\\d+)", line).replace(" ", r"\s+")
        for k, name in enumerate(re.findall(r"[{](\w+)[}]", line), 1):
            out.append(F.nullif(F.regexp_extract("log", pattern, k), F.lit("")).cast("long").alias(name))
    found = lambda k: F.regexp_extract_all("log", F.lit(r"Found\s+(\d+)\s+(\w+)\s+files"), F.lit(k))
    # A language found twice counts with its last number.
    last = F.aggregate(
        F.arrays_zip(found(2).alias("lang"), found(1).alias("n")),
        F.create_map().cast("map<string, bigint>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["lang"]), F.create_map(x["lang"], x["n"].cast("long"))),
    )
    return logs.select("*", *out, last.alias("language_files"))
