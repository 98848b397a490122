"""Look-ups by name and path: tiers, closest names, cascades, first of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

SYMBOL_LIMIT = 50
RERANK_FROM, RERANK_TO = 20, 10


def name_tier(name: Column, query: str) -> Column:
    low = F.lower(name)
    return F.when(low == query.lower(), 0).when(low.startswith(query.lower()), 1).otherwise(2)


def matching(symbols: DataFrame, query: str, kind: str | None = None, module: str | None = None) -> DataFrame:
    """Symbols whose name holds the query, with optional type and path prefix."""
    found = symbols.where(F.lower("name").contains(query.lower()))
    if kind:
        found = found.where(F.col("type") == kind)
    return found.where(F.col("file").startswith(module)) if module else found


def find_symbol(symbols: DataFrame, query: str, kind: str | None = None, module: str | None = None, limit: int = SYMBOL_LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Best names first: equal, beginning, containing; exported first; then by name.

    ``hits`` (qualified_name, vrank): where more than 20 names fit, the ten that the vector
    search ranks best, the others after them.
    """
    found = matching(symbols, query, kind, module).withColumn("tier", name_tier(F.col("name"), query))
    order = [F.col("tier"), F.col("is_exported").desc(), F.col("name"), F.col("qualified_name")]
    ranked = found.orderBy(*order).limit(limit)
    if hits is None:
        return ranked
    base = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows
    if base.count() <= RERANK_FROM:
        return base
    return base.join(F.broadcast(hits), "qualified_name", "left").orderBy(F.col("vrank").asc_nulls_last(), "rank").limit(RERANK_TO)


def closest(candidates: DataFrame, query: str, n: int = 3) -> DataFrame:
    """(name, score): the n closest names, those without likeness left out after the cut."""
    return candidates.select("name", T.closeness(F.col("name"), query).alias("score")).orderBy(F.desc("score"), "name").limit(n).where("score > 0")


def disambiguate(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols by qualified name, else by ``path::name`` suffix, else by simple name; the first tier that fits."""
    tier = F.when(F.col("qualified_name") == query, 1).when(F.col("qualified_name").endswith("/" + query), 2).when(F.col("name") == query, 3)
    return first_tier(symbols.withColumn("tier", tier))


def first_tier(rows: DataFrame) -> DataFrame:
    """Rows of the least ``tier`` there is."""
    fits = rows.where("tier is not null")
    best = fits.agg(F.min("tier").alias("__best"))
    return fits.join(F.broadcast(best), F.col("tier") == F.col("__best")).drop("__best")


def find_file(files: DataFrame, query: str, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx")) -> DataFrame:
    """The one file that a path names: as it is, as a suffix, or so with an extension."""
    path, tier = F.col("path"), F.when(F.col("path") == query, 0).when(F.col("path").endswith("/" + query), 1)
    for k, e in enumerate(extensions):
        tier = tier.when(path == query + e, 2 + 2 * k).when(path.endswith("/" + query + e), 3 + 2 * k)
    return files.withColumn("tier", tier).where("tier is not null").orderBy("tier", "path").limit(1)


def find_files(files: DataFrame, queries: list[str], extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx")) -> DataFrame:
    """(query, path, tier) for up to 20 paths at once, in one pass over the files."""
    if not 1 <= len(queries) <= 20:
        raise ValueError("from 1 to 20 files")
    spark = files.sparkSession
    q = spark.createDataFrame([(x, x.rsplit("/", 1)[-1] + e, x + e, k) for x in dict.fromkeys(queries) for k, e in enumerate(("", *extensions))], "query string, base string, full string, k int")
    joined = files.withColumn("base", T.base_name(F.col("path"))).join(F.broadcast(q), "base")
    tier = F.when(F.col("path") == F.col("full"), F.col("k") * 2).when(F.col("path").endswith(F.concat(F.lit("/"), F.col("full"))), F.col("k") * 2 + 1)
    return joined.withColumn("tier", tier).where("tier is not null").groupBy("query").agg(F.min(F.struct("tier", "path")).alias("b")).select("query", "b.path", "b.tier")


def top_of_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark cuts each task's part before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def priority(rank: Column, size: int = 10) -> Column:
    """Priority of a section by its rank: 1 for the first ``size``, then 2, and so on."""
    return (F.floor((rank - 1) / size) + 1).cast("int")


def template_match(files: DataFrame, description: str, n: int = 3) -> DataFrame:
    """(path, score): files that hold most of a description's words in purpose, path or exports."""
    words = files.sparkSession.range(1).select(T.template_terms(F.lit(description)).alias("w"))
    combined = F.lower(F.concat_ws(" ", F.coalesce("purpose", F.lit("")), "path", F.concat_ws(" ", "exports")))
    scored = files.join(F.broadcast(words)).select("path", F.size(F.filter("w", lambda t: combined.contains(t))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(n)


def feature_match(features: DataFrame, query: str, n: int) -> DataFrame:
    """(id, name, hits): features by how many query words they hold; those without come last, by id."""
    if not 1 <= n <= 20:
        raise ValueError("from 1 to 20 features")
    words = [w for w in query.lower().split() if w]
    hay = F.lower(F.concat_ws(" ", "name", "description"))
    hits = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return features.select("id", "name", hits.alias("hits")).orderBy(F.desc("hits"), "id").limit(n)
