"""The query endpoints over a store of knowledge tables, each giving DataFrames.

Arguments are checked on the driver; wrong ones raise ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import text as T
from .operators import artifacts, dashboards, graph, lookup, retrieval, search
from .plans.catalog import Memory, Store, build, within
from .sources import files

@dataclass
class Knowledge:
    """A store, read as of its current generation."""

    spark: SparkSession
    path: str
    memory: Memory = field(default_factory=Memory)

    def __post_init__(self):
        self.store = Store(self.spark, self.path)

    def t(self, name: str) -> DataFrame:
        return self.store.table(name)

    def _vectors(self, scope: str | None = None) -> DataFrame:
        v = self.t("vectors")
        return v.where(F.col("scope") == scope) if scope else v

    # --- overview ---

    def get_project_overview(self, depth: int = 2) -> dict[str, DataFrame]:
        if not 1 <= depth <= 4:
            raise ValueError("depth must be from 1 to 4")
        s, f = self.t("symbols"), self.t("files")
        return {
            "index": dashboards.index_summary(s, self.t("meta").select("richness").first().richness),
            "languages": dashboards.counts(f, "language").orderBy(F.desc("n"), "language"),
            "tree": files.file_tree(f, depth),
            "modules": dashboards.module_table(s, self.t("module_edges")),
            "entry_points": dashboards.entry_points(s),
            "cycles": self.t("cycles"),
        }

    def get_module_context(self, module: str) -> dict[str, DataFrame]:
        inside = lambda c: F.col(c).startswith(module + "/") | (F.col(c) == module)
        f, s = self.t("files").where(inside("path")), self.t("symbols").where(inside("file"))
        return {
            "files": f.select("path", "role", F.coalesce("llm_description", "detailed_purpose", "purpose").alias("purpose")).orderBy("path"),
            "exports": lookup.top_of_group(s.where("is_exported and type != 'module-init'"), ["file"], [F.col("line")], 20).select("file", "name", "type", "signature"),
            "imports": dashboards.common_imports(self.t("files"), module),
            "roles": dashboards.role_counts(f),
            "types": dashboards.counts(s, "type"),
        }

    def get_implementation_context(self, file: str, snippets: bool = True) -> dict[str, DataFrame]:
        found = lookup.find_file(self.t("files"), file)
        path = found.select("path").first()
        if path is None:
            return {"closest": lookup.closest(self.t("files").select(F.col("path").alias("name")), file)}
        p, s = path.path, self.t("symbols")
        own = s.where(F.col("file") == p)
        called = own.select("qualified_name", F.explode(F.slice("called_by", 1, 3)).alias("caller"))
        who = s.select(F.col("qualified_name").alias("caller"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"))
        out = {
            "summary": found,
            "symbols": own.orderBy("line").limit(20),
            "callers": called.join(who, "caller", "left"),
            "imports": found.select(F.explode("dependencies").alias("dep")).select("dep", T.import_kind(F.col("dep")).alias("kind")),
            "imported_by": self.t("imports").where(F.col("dep") == p).select("file"),
            "siblings": self.t("files").where((T.folder(F.col("path")) == p.rpartition("/")[0]) & (F.col("path") != p)).select("path"),
            "similar": self._similar("file:" + p),
        }
        if snippets:
            text = found.where(~T.is_sensitive(F.col("path")) & (F.octet_length("content") <= 1_000_000)).select("path", "content")
            top = own.where("is_exported").orderBy("line").limit(5).select("name", "line", F.col("file").alias("path"))
            out["snippets"] = top.join(text, "path").select("name", "line", search.snippet(F.col("content"), F.col("line")).alias("snippet"))
        return out

    def _similar(self, own: str) -> DataFrame:
        v = self._vectors("files")
        row = v.where(F.col("id") == own).select("embedding").first()
        return retrieval.similar(v, own, row.embedding, vec_id="id") if row else v.select("id", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score")).limit(0)

    def get_batch_summaries(self, paths: list[str]) -> DataFrame:
        found = lookup.find_files(self.t("files"), paths)
        return found.join(self.t("files").drop("content"), "path").withColumn("exports", F.slice("exports", 1, 10))

    # --- symbols, calls, dependencies ---

    def find_symbol(self, name: str, kind: str | None = None, module: str | None = None, vector: list[float] | None = None) -> DataFrame:
        hits = None
        if vector is not None:
            near = retrieval.knn(self._vectors("symbols"), vector, 100, vec_id="id")
            hits = retrieval.ranked(near, F.col("distance"), F.col("id")).select(F.regexp_replace("id", "^symbol:", "").alias("qualified_name"), F.col("rank").alias("vrank"))
        return lookup.find_symbol(self.t("symbols"), name, kind, module, hits=hits)

    def closest_symbols(self, name: str) -> DataFrame:
        return lookup.closest(self.t("symbols").select("name").distinct(), name)

    def find_callers(self, symbol: str, max_depth: int = 3, direction: str = "callers") -> DataFrame:
        s = self.t("symbols")
        start = lookup.disambiguate(s, symbol).orderBy("qualified_name").select("qualified_name").first()
        calls = s.select(F.col("qualified_name").alias("caller"), F.explode("calls").alias("callee"))
        return graph.call_search(calls, s, start.qualified_name if start else symbol, max_depth, direction)

    def get_dependencies(self, module: str, depth: int = 1) -> DataFrame:
        return graph.dependency_search(self.t("module_edges"), module, depth)

    def get_file_summary(self, file: str) -> DataFrame:
        return lookup.find_file(self.t("files"), file).drop("content")

    # --- search ---

    def search_architecture(self, query: str) -> DataFrame:
        docs = self.t("files").where(F.col("path").endswith(".md")).select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
        return search.search_all(docs, self.t("files"), self.t("symbols"), query)

    def semantic_search(self, query: str, scope: str | None = None, k: int = 10, vector: list[float] | None = None) -> DataFrame:
        if not 1 <= k <= 50:
            raise ValueError("k must be from 1 to 50")
        if scope not in (None, "all", "files", "symbols", "features"):
            raise ValueError(f"unknown scope {scope!r}")
        r = self.spark.range(1).select(retrieval.route(F.lit(query)).alias("r")).select("r", retrieval.refined_scope(F.lit(scope).cast("string"), F.col("r")).alias("scope")).first()
        own = None if r.scope == "all" else r.scope

        def make() -> DataFrame:
            docs = retrieval.knowledge_documents(self.t("files"), self.t("symbols"), self.t("features"))
            kw = retrieval.bm25(docs, query, 3 * k).withColumnRenamed("doc_id", "id")
            tables = []
            if vector is not None:
                tables = [retrieval.knn(self._vectors(s), vector, 2 * k, vec_id="id").select("id", "distance") for s in ("files", "symbols", "features") if own in (None, s)]
            return retrieval.hybrid(kw, tables, k, own.rstrip("s") if own else None).withColumn("strategy", F.lit(r.r.strategy))

        return self.memory.get(self.store.generation, ("semantic", query, scope, k, tuple(vector or ())), make)

    def explore_graph(self, start: str, edge_types: list[str] | None = None, max_depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        from .schemas import EDGE_TYPES

        if wrong := set(edge_types or ()) - set(EDGE_TYPES):
            raise ValueError(f"unknown edge types {sorted(wrong)}")
        key = ("explore", start, tuple(edge_types or ()), max_depth, direction)
        return self.memory.get(self.store.generation, key, lambda: graph.traverse(self.t("nodes"), self.t("edges"), start, edge_types, max_depth, direction))

    def get_feature_context(self, query: str, k: int = 3, vector: list[float] | None = None) -> DataFrame:
        f = self.t("features")
        if vector is None:
            return lookup.feature_match(f, query, k)
        near = retrieval.knn(self._vectors("files"), vector, 2 * k, vec_id="id")
        rank = retrieval.ranked(near, F.col("distance"), F.col("id")).select(F.regexp_replace("id", "^file:", "").alias("file"), "rank")
        hit = f.select("id", "name", F.explode("files").alias("file")).join(F.broadcast(rank), "file")
        return hit.groupBy("id", "name").agg(F.min("rank").alias("rank")).orderBy("rank", "id").limit(k)

    def find_template_file(self, description: str, vector: list[float] | None = None) -> DataFrame:
        if vector is not None:
            return retrieval.knn(self._vectors("files"), vector, 5, vec_id="id")
        return lookup.template_match(self.t("files"), description)

    def get_code_patterns(self, kind: str | None = None) -> dict[str, DataFrame]:
        f, s = self.t("files"), self.t("symbols")
        labelled = f.select("path", F.explode(T.file_labels(F.col("path"), F.col("purpose"))).alias("label"))
        deps = f.select(F.explode("dependencies").alias("dep"))
        return {
            "structure": dashboards.structure(s),
            "labels": dashboards.label_counts(f),
            "examples": lookup.top_of_group(labelled if kind is None else labelled.where(F.col("label") == kind), ["label"], [F.col("path")], 3),
            "data_access": dashboards.detected(deps, dashboards.ORMS),
            "styling": dashboards.detected(deps, dashboards.STYLES),
        }

    # --- health and artifacts ---

    def health_check(self) -> DataFrame:
        m = self.t("meta").first()
        disk = files.listing(self.spark, m.root).where(files.language_column(F.col("path")).isNotNull())
        return dashboards.health(self.t("files"), disk, F.lit(m.built), m.errors, m.richness)

    def get_artifact_schema(self, kind: str) -> DataFrame:
        if kind not in artifacts.SCHEMAS:
            raise ValueError(f"unknown artifact {kind!r}; known: {', '.join(artifacts.SCHEMAS)}")
        return self.spark.createDataFrame(list(artifacts.SCHEMAS[kind].items()), "key string, type string")

    def get_artifact_store_path(self, kind: str) -> str:
        return artifacts.artifact_path(kind)

    def validate_artifact_draft(self, kind: str, draft: str) -> DataFrame:
        return artifacts.validate(self.spark.createDataFrame([(0, draft)], "id int, json string"), kind)

    def get_cumulative_context(self, phase: str, root: str) -> DataFrame:
        """Previews of the artifacts of all prior phases that there are."""
        rows = []
        for p in artifacts.prior_phases(phase):
            path = f"{root.rstrip('/')}/{artifacts.artifact_path(artifacts.artifact_of(p))}"
            fs, hp = self.store._fs(path)
            if fs.exists(hp):
                rows.append(self.spark.read.text(path, wholetext=True).select(F.lit(p).alias("id"), F.col("value").alias("json")))
        if not rows:
            return artifacts.preview(self.spark.createDataFrame([], "id string, json string"))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return artifacts.preview(out)

    def get_directory_tree(self, path: str = "", depth: int = 3) -> DataFrame:
        if not 1 <= depth <= 5:
            raise ValueError("depth must be from 1 to 5")
        if ".." in path.split("/"):
            raise ValueError("path leaves the root")
        f = self.t("files").select("path")
        own = path.strip("/")
        f = f.where(F.col("path").startswith(own + "/")).select(F.substring("path", len(own) + 2, 1_000_000).alias("path")) if own else f
        return files.file_tree(f, depth)

    def get_static_data_schema(self) -> DataFrame:
        return self.t("files").where(T.is_data(F.col("path"))).select("path", "exports", "purpose").orderBy("path")

    def rebuild_knowledge(self, root: str, timeout: float = 600.0, **options) -> int:
        """A new generation; the build is stopped after ``timeout`` seconds (60 to 1800)."""
        if not 60 <= timeout <= 1800:
            raise ValueError("timeout must be from 60 to 1800 seconds")
        self.memory.clear()
        return within(self.spark, timeout, lambda: build(self.spark, root, self.store, **options))

    def footer(self) -> DataFrame:
        """One row (text): age, richness, files and staleness of the tables."""
        m = self.t("meta").first()
        stale = dashboards.is_stale(files.listing(self.spark, m.root).where(files.language_column(F.col("path")).isNotNull()), F.lit(m.built))
        n = self.t("files").agg(F.count(F.lit(1)).alias("n"))
        return n.join(F.broadcast(stale)).select(render.footer(F.lit(m.built), F.current_timestamp(), F.lit(m.richness), F.col("n"), F.col("stale")).alias("text"))

    def text_of_symbols(self, name: str, **options) -> str:
        """find_symbol as text within its byte budget, sections by rank."""
        found = self.find_symbol(name, **options)
        rows = render.symbol_line(found).collect()  # at most 50
        if not rows:
            near = ", ".join(r.name for r in self.closest_symbols(name).collect())
            return f"No symbol matches {name!r}." + (f" Close: {near}." if near else "")
        sections = [render.Section("", r.text, 1 + k // 10) for k, r in enumerate(rows)]
        return render.respond([*sections, render.Section("", self.footer().first().text, render.FOOTER)], "find_symbol")
