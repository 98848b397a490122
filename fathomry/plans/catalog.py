"""Builds of the knowledge tables in generations, and caches keyed by generation.

A build writes all tables to ``gen=N`` and then moves the pointer, so readers see either the
old set or the new one.  A build that fails leaves the pointer where it was.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import cluster, dashboards, graph, incremental
from ..sources import extract, files

SYMBOLS = schemas.ddl(
    """file string, module string, language string, name string, qualified_name string, line int, signature string, type string, is_exported boolean, jsdoc string,
    decorators array<string>, complexity int, is_async boolean, access_modifier string, return_type string,
    parameters array<struct<name: string, type: string, optional: boolean, default_value: string>>, throws array<string>, deprecation_notice string,
    calls array<string>, called_by array<string>"""
)
FILES = schemas.ddl(
    """path string, module string, language string, content string, content_hash string, purpose string, detailed_purpose string, llm_description string, exports array<string>,
    dependencies array<string>, throws array<string>, patterns array<string>, role string, complexity bigint, test_files array<string>, modified timestamp"""
)
FEATURES = schemas.ddl("id string, name string, description string, files array<string>, related_features array<string>")
TABLES = {
    "symbols": SYMBOLS,
    "files": FILES,
    "imports": schemas.IMPORTS,
    "sites": schemas.ddl("caller string, file string, name string"),
    "module_edges": schemas.MODULE_EDGES,
    "cycles": schemas.ddl("component string, members array<string>"),
    "features": FEATURES,
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
    "vectors": schemas.VECTORS,
    "meta": schemas.ddl("generation int, built timestamp, richness string, errors int, root string"),
}


class Store:
    """A folder of generations on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @property
    def generation(self) -> int:
        """The current generation; 0 before the first build."""
        fs, p = self._fs(f"{self.path}/current")
        return max((int(s.getPath().getName()[4:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("gen-")), default=0) if fs.exists(p) else 0

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        n = self.generation if generation is None else generation
        return files.read_table(self.spark, f"{self.path}/gen={n}/{name}", TABLES[name])

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write a generation and point to it; the marker is created once, so two builds can't take one number."""
        n = self.generation + 1
        fs, lock = self._fs(f"{self.path}/gen={n}/_building")
        if fs.exists(lock):
            raise RuntimeError(f"generation {n} is being built")
        fs.create(lock, False).close()
        try:
            for name, df in tables.items():
                df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).write.mode("overwrite").parquet(f"{self.path}/gen={n}/{name}")
        except Exception:
            self._fs(f"{self.path}/gen={n}")[0].delete(self._fs(f"{self.path}/gen={n}")[1], True)
            raise
        fs.create(self._fs(f"{self.path}/current/gen-{n}")[1], False).close()
        fs.delete(lock, False)
        return n


class Memory:
    """Results kept for a while by (generation, key); the least recently used goes first."""

    def __init__(self, size: int = 50, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, generation: int, key, make: Callable):
        now, k = self.clock(), (generation, key)
        if k in self.held and now - self.held[k][0] < self.seconds:
            self.held.move_to_end(k)
            self.hits += 1
            return self.held[k][1]
        self.misses += 1
        self.held[k] = (now, make())
        self.held.move_to_end(k)
        for old in [x for x in self.held if x[0] != generation]:
            del self.held[old]
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[k][1]

    def clear(self) -> None:
        self.held.clear()


def retried(f: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """f(), tried again after 1, 2, 4 ... seconds."""
    for k in range(attempts):
        try:
            return f()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)


def within(spark: SparkSession, seconds: float, f: Callable):
    """f(), whose Spark jobs are stopped after a time; then TimeoutError."""
    import threading
    import uuid

    group, late, done, sc = f"build-{uuid.uuid4().hex}", threading.Event(), threading.Event(), spark.sparkContext

    def stop() -> None:
        if done.wait(seconds):
            return
        late.set()
        while not done.wait(0.5):  # also stops jobs that begin afterwards
            sc.cancelJobGroup(group)

    sc.setJobGroup(group, "build", True)
    threading.Thread(target=stop, daemon=True).start()
    try:
        return f()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)


def tables_of(spark: SparkSession, sources: DataFrame, extracted: DataFrame, roots: list[str] | None = None, project: str = "project", vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """All knowledge tables of sources (path, content, language, modified) and what was read from them."""
    raw = extract.symbols_of(extracted)
    sites, imports = extract.sites_of(extracted), extract.imports_found(extracted)
    calls = graph.scratch(graph.resolve_calls(sites, raw), "calls")
    none = F.array().cast("array<string>")
    out = calls.groupBy(F.col("caller").alias("qualified_name")).agg(F.array_sort(F.collect_set("callee")).alias("__calls"))
    symbols = graph.with_callers(raw, calls).join(out, "qualified_name", "left").withColumn("calls", F.coalesce("__calls", none)).drop("__calls")
    symbols = graph.scratch(symbols, "symbols")
    module = T.module_name(F.col("path"), roots or [], project)
    modules = sources.select("path", module.alias("module"))
    edges = graph.scratch(graph.module_edges(imports, modules), "module-edges")
    exports = dashboards.public_api(symbols).select(F.col("file").alias("path"), "exports")
    thrown = dashboards.distinct_throws(symbols).withColumnRenamed("file", "path")
    cost = dashboards.file_complexity(symbols).withColumnRenamed("file", "path")
    deps = imports.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list("dep")).alias("dependencies"))
    tests = incremental.symbol_tests(sources, imports).groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_list("test")).alias("test_files"))
    described = F.concat(T.static_purpose(F.col("path")), F.when(F.size("exports") > 0, F.concat(F.lit(" exporting "), F.array_join(F.slice("exports", 1, 5), ", "))).otherwise(""))
    base = sources.select("path", module.alias("module"), "language", "content", T.content_hash(F.col("content")).alias("content_hash"), T.static_purpose(F.col("path")).alias("purpose"), F.lit(None).cast("string").alias("llm_description"), T.detected_patterns(F.col("content"), F.col("path")).alias("patterns"), T.role_with_tests(F.col("path")).alias("role"), "modified")
    for extra in (exports, thrown, cost, deps, tests):
        base = base.join(extra, "path", "left")
    summary = base.withColumns({c: F.coalesce(c, none) for c in ("exports", "throws", "dependencies", "test_files")}).withColumn("detailed_purpose", described)
    summary = graph.scratch(summary, "files")
    own_vectors = vectors if vectors is not None else spark.createDataFrame([], schemas.VECTORS)
    if vectors is not None:
        groups = cluster.features(cluster.kmeans(vectors.where("scope = 'files'").select(F.regexp_replace("id", "^file:", "").alias("id"), "embedding")))
        member = groups.select("id", F.explode("files").alias("member"))
        like = cluster.overlaps(member).groupBy("id").agg(F.array_sort(F.collect_list("related")).alias("related_features"))
        features = groups.select("id", "name", "description", "files").join(like, "id", "left").withColumn("related_features", F.coalesce("related_features", none))
        features = graph.scratch(features, "features")
    else:
        features = spark.createDataFrame([], FEATURES)
    nodes, links = graph.assemble(symbols, summary, edges, calls, imports, features)
    return {
        "symbols": symbols, "files": summary, "imports": imports, "sites": sites, "module_edges": edges, "cycles": graph.cycles(edges), "features": features, "nodes": nodes, "edges": links, "vectors": own_vectors,
    }


def build(
    spark: SparkSession,
    root: str,
    store: Store,
    exclude: list[str] | None = None,
    roots: list[str] | None = None,
    richness: str = "standard",
    is_incremental: bool = False,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Read a source tree and publish a generation; its number.

    Incremental: files whose content hash is as in the last generation aren't read again; their
    symbols, sites and imports are taken over.  ``embed`` (id, text) -> (id, embedding) gives
    vectors for files and exported symbols; without it there are none.
    """
    if richness not in ("minimal", "standard", "rich"):
        raise ValueError(f"richness must be minimal, standard or rich, not {richness!r}")
    sources = graph.scratch(files.read_sources(spark, root, exclude), "sources")
    gomod = files.go_module(spark, root)
    last = store.generation
    if is_incremental and last:
        old = store.table("files", last).select("path", "content_hash")
        now = sources.withColumn("content_hash", T.content_hash(F.col("content")))
        fresh = now.join(incremental.changed(now, old).select("path"), "path", "left_semi")
        kept = now.join(old, ["path", "content_hash"], "left_semi").select("path")
        extracted = extract.extract(fresh, gomod).unionByName(_as_extracted(store, last, kept))
    else:
        extracted = extract.extract(sources, gomod)
    extracted = graph.scratch(extracted, "extracted")
    vectors = None
    if embed is not None:
        s = extract.symbols_of(extracted).where("is_exported")
        texts = sources.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("files").alias("scope"), F.concat_ws(" ", T.static_purpose(F.col("path")), F.substring("content", 1, 2000)).alias("text"))
        texts = texts.unionByName(s.select(F.concat(F.lit("symbol:"), "qualified_name").alias("id"), F.lit("symbols").alias("scope"), F.concat_ws(": ", "qualified_name", "signature").alias("text")))
        vectors = graph.scratch(texts.join(embed(texts.select("id", "text")), "id").select("id", "scope", "embedding", F.create_map(F.lit("text"), F.substring("text", 1, 200)).alias("metadata")), "vectors")
    tables = tables_of(spark, sources, extracted, roots, root.rstrip("/").rsplit("/", 1)[-1], vectors)
    tables["meta"] = spark.range(1).select(F.lit(last + 1).alias("generation"), F.current_timestamp().alias("built"), F.lit(richness).alias("richness"), F.lit(0).alias("errors"), F.lit(root).alias("root"))
    return store.publish(tables)


def _as_extracted(store: Store, generation: int, kept: DataFrame) -> DataFrame:
    """Symbols, sites and imports of unchanged files as the extractor gives them."""
    schema = extract.extract(store.spark.createDataFrame([], "path string, content string")).schema
    s = store.table("symbols", generation).groupBy(F.col("file").alias("path")).agg(
        F.collect_list(F.struct(*[F.col(f.name) for f in schema["symbols"].dataType.elementType.fields])).alias("symbols")
    )
    c = store.table("sites", generation).groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("caller", "name")).alias("sites"))
    i = store.table("imports", generation).groupBy(F.col("file").alias("path")).agg(
        F.collect_list(F.struct(F.col("dep").alias("spec"), "is_dynamic", F.hash("dep").alias("ord"), F.array("dep").alias("candidates"))).alias("imports")
    )
    out = kept.join(s, "path", "left").join(c, "path", "left").join(i, "path", "left")
    return out.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.array().cast(f.dataType)).alias(f.name) if f.name != "path" else F.col("path") for f in schema.fields])
