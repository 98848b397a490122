"""Source trees, artifacts and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .languages import BY_EXTENSION, MARKERS, language_of, skipped_folders

MAX_SOURCE_BYTES = 2 * 1024 * 1024
MAX_ARTIFACT_BYTES = 50 * 1024 * 1024


def language_column(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(BY_EXTENSION.items()) for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def _relative(root: str) -> Column:
    """Path below the root, from the reader's file path."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^[a-zA-Z]+:/*" + T.quoted(root.split(":", 1)[-1].strip("/")) + "/", "")


def _open_folders(path: Column, exclude: list[str]) -> Column:
    """Whether no folder of the path is skipped, hidden or excluded (by name, or by path if it has a slash)."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    names = [*skipped_folders(), *(e for e in exclude if "/" not in e)]
    fine = ~F.exists(folders, lambda f: f.startswith(".") | f.isin(names))
    for e in exclude:
        if "/" in e:
            fine = fine & ~path.startswith(e.strip("/") + "/")
    return fine


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, modified, size) below a root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    found = reader.load(root).select(_relative(root).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return found.where(_open_folders(F.col("path"), exclude or []))


def read_sources(spark: SparkSession, root: str, exclude: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, content, language, modified) of the source files below a root, up to 2 MB each."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    rows = raw.select(_relative(root).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
    rows = rows.withColumn("language", language_column(F.col("path"))).where(F.col("language").isNotNull() & (F.col("size") <= MAX_SOURCE_BYTES) & _open_folders(F.col("path"), exclude or [])).drop("size")
    return rows.orderBy("path").limit(limit) if limit else rows


def project_languages(paths: DataFrame, depth: int = 3) -> DataFrame:
    """(language) by marker files at the root, else by extensions down to a depth."""
    marks = [(m, lang) for lang, all_of in MARKERS.items() for m in all_of]
    table = F.broadcast(paths.sparkSession.createDataFrame(marks, "path string, language string"))
    marked = paths.join(table, "path").select("language").distinct()
    if not marked.isEmpty():
        return marked
    near = paths.where(F.size(F.split("path", "/")) <= depth + 1)
    return near.select(language_column(F.col("path")).alias("language")).where("language is not null").distinct()


def source_globs(language: str) -> list[str]:
    return [f"**/*{e}" for e, lang in sorted(BY_EXTENSION.items()) if lang == language]


def file_tree(paths: DataFrame, depth: int = 2) -> DataFrame:
    """(parent, name, is_dir): entries down to a depth, folders first, then by name."""
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))))
    rows = paths.select(parts.alias("p"), level.alias("k")).select(
        F.array_join(F.slice("p", 1, F.col("k") - 1), "/").alias("parent"), F.element_at("p", F.col("k")).alias("name"), (F.col("k") < F.size("p")).alias("is_dir")
    )
    return rows.groupBy("parent", "name").agg(F.max("is_dir").alias("is_dir")).orderBy("parent", F.desc("is_dir"), "name")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON artifact as rows; an absent, malformed or oversized one gives no rows."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath) or fs.getContentSummary(hpath).getLength() > MAX_ARTIFACT_BYTES:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return rows.where(" or ".join(f"`{f.name}` is not null" for f in schema.fields))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, empty if it isn't there."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# Packages that name a framework or build tool, and the kinds of project they mean.
STACK = {
    "framework": ("next", "react", "vue", "svelte", "@angular/core", "express", "fastify", "@nestjs/core"),
    "build": ("vite", "webpack", "esbuild", "rollup", "turbo", "typescript"),
}
KINDS = (("next", "fullstack-web"), ("@nestjs/core", "backend"), ("express", "backend"), ("fastify", "backend"), ("react", "frontend"), ("vue", "frontend"), ("svelte", "frontend"))


def tech_stack(manifests: DataFrame) -> DataFrame:
    """(kind, name) that package manifests (content) declare, in order of the table."""
    deps = manifests.select(F.explode(F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])).alias("dep"))
    rows = [(kind, name, k) for kind, names in STACK.items() for k, name in enumerate(names)]
    table = F.broadcast(manifests.sparkSession.createDataFrame(rows, "kind string, name string, ord int"))
    return deps.distinct().join(table, F.col("dep") == F.col("name")).orderBy("kind", "ord").select("kind", "name")


def project_kind(stack: DataFrame) -> DataFrame:
    """One row (kind): the first kind that a declared package means, else library."""
    flags = stack.agg(*[F.coalesce(F.max(F.col("name") == n), F.lit(False)).alias(f"k{i}") for i, (n, _) in enumerate(KINDS)])
    return flags.select(F.coalesce(*[F.when(F.col(f"k{i}"), F.lit(kind)) for i, (_, kind) in enumerate(KINDS)], F.lit("library")).alias("kind"))


def go_module(spark: SparkSession, root: str) -> str:
    """Module path of a root's go.mod; empty without one."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter="go.mod")
    found = rows.select(F.regexp_extract("value", r"(?m)^module\s+(\S+)", 1).alias("m")).limit(1).collect()
    return found[0].m if found else ""


def read_config(spark: SparkSession, path: str) -> dict:
    """moduleRoots, richness and exclude of a JSON config; defaults where it is absent or broken."""
    schema = StructType.fromDDL("moduleRoots array<string>, richness string, exclude array<string>")
    rows = read_json(spark, path, schema).limit(1).collect()
    found = rows[0] if rows else None
    rich = found.richness if found and found.richness in ("minimal", "standard", "rich") else "standard"
    return {"roots": list(found.moduleRoots or []) if found else [], "richness": rich, "exclude": list(found.exclude or []) if found else []}


def project_name(manifests: DataFrame, root: str) -> DataFrame:
    """(name, main) that manifests (content) give; else the root's last segment and null."""
    one = manifests.agg(F.max(F.get_json_object("content", "$.name")).alias("n"), F.max(F.get_json_object("content", "$.main")).alias("main"))
    return one.select(F.coalesce(F.nullif("n", F.lit("")), F.lit(root.rstrip("/").rsplit("/", 1)[-1])).alias("name"), "main")


def safe_path(root: str, path: str) -> str | None:
    """A local path below the root, links followed; null if it leads outside."""
    import os

    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    return full if full == base or full.startswith(base + os.sep) else None


def import_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as other tools write a graph: nodes, and edges or links or relationships."""
    node = "array<struct<id: string, name: string, label: string, type: string, path: string>>"
    edge = "array<struct<source: string, target: string, type: string, relation: string>>"
    v = docs.select(F.from_json("json", f"struct<nodes: {node}, edges: {edge}, links: {edge}, relationships: {edge}>").alias("g"))
    nodes = v.select(F.inline("g.nodes"))
    edges = v.select(F.inline(F.coalesce("g.edges", "g.links", "g.relationships"))).select("source", "target", F.coalesce("relation", "type").alias("relation"))
    return nodes, edges


__all__ = ["file_tree", "go_module", "import_graph", "language_column", "language_of", "listing", "project_kind", "project_languages", "project_name", "read_config", "read_json", "read_sources", "read_table", "safe_path", "source_globs", "tech_stack"]
