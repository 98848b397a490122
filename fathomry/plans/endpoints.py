"""Registered queries of the endpoints: a generation of the driver's tables is published, then asked through ``Knowledge``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..api import Knowledge
from ..operators import graph
from ..operators.vector_store import VectorStore
from ..tables import shared_dir
from .catalog import TABLES
from .queries import FILES, L2, ORACLES, SYMBOLS, query
from .views import Views


def folder(v: Views) -> str:
    return f"{shared_dir(v.spark)}/fathomry/{v.spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"


def filled(rows: DataFrame, schema: StructType) -> DataFrame:
    """With the schema's other columns: null, arrays empty."""
    return rows.withColumns({f.name: (F.array() if isinstance(f.dataType, ArrayType) else F.lit(None)).cast(f.dataType) for f in schema.fields if f.name not in rows.columns})


def served(v: Views, **tables: DataFrame) -> Knowledge:
    k = Knowledge(v.spark, folder(v))
    k.store.publish({name: filled(rows, TABLES[name]) for name, rows in tables.items()})
    return k


def symbols(v: Views) -> DataFrame:
    """Parts; each calls the part of twice its number."""
    return v.symbols.withColumns({"signature": F.col("name"), "calls": F.array(F.concat(F.lit("part:"), (2 * F.col("line")).cast("string")))})


@query(ORACLES["find_symbol_tiered"])
def api_find_symbol(v: Views) -> DataFrame:
    return served(v, symbols=symbols(v)).find_symbol("Red").select("name", "qualified_name", "is_exported", "tier")


CALL_STEPS = f"{SYMBOLS}, calls as (select qualified_name caller, 'part:' || 2 * line callee from symbols)"
CALL_ROWS = "select node qualified_name, depth::integer depth, coalesce(file, 'unknown') file, coalesce(line, 0)::integer line from w left join symbols on qualified_name = node where depth > 0"


@query(f"with recursive {CALL_STEPS}, w as (select 'part:40' node, 0 depth union all select caller, depth + 1 from w join calls on callee = node where depth < 3) {CALL_ROWS}")
def api_find_callers(v: Views) -> DataFrame:
    return served(v, symbols=symbols(v)).find_callers("part:40")


@query(f"with recursive {CALL_STEPS}, w as (select 'part:60' node, 0 depth union all select callee, depth + 1 from w join calls on caller = node where depth < 3) {CALL_ROWS}")
def api_find_callees(v: Views) -> DataFrame:
    return served(v, symbols=symbols(v)).find_callers("part:60", direction="callees")


@query(ORACLES["module_deps_bfs"])
def api_dependencies(v: Views) -> DataFrame:
    k = served(v, module_edges=graph.typed_edges(v.module_rows))
    return k.get_dependencies(k.t("module_edges").agg(F.min("src")).first()[0], 3)


@query(f"with {FILES} select path, module, content_hash, 1::integer tier from files where ends_with(path, '/doc_3.txt')")
def api_file_summary(v: Views) -> DataFrame:
    return served(v, files=v.files).get_file_summary("doc_3.txt").select("path", "module", "content_hash", "tier")


@query(f"""with {FILES}, q as (select unnest(['doc_1.txt', 'doc_3.txt', 'no.txt']) query)
select query, path, 1::integer tier, content_hash from files join q on ends_with(path, '/' || query)""")
def api_batch_summaries(v: Views) -> DataFrame:
    return served(v, files=v.files).get_batch_summaries(["doc_1.txt", "doc_3.txt", "no.txt"]).select("query", "path", "tier", "content_hash")


@query(f"""with {SYMBOLS}, r as (select file, name, type, row_number() over (partition by file order by line) rn from symbols where is_exported and starts_with(file, 'Brand#13/'))
select file, name, type, name signature from r where rn <= 20""")
def api_module_exports(v: Views) -> DataFrame:
    return served(v, symbols=symbols(v)).get_module_context("Brand#13")["exports"]


@query(f"with {SYMBOLS} select type, count(*) n from symbols where starts_with(file, 'Brand#13/') group by type")
def api_module_types(v: Views) -> DataFrame:
    return served(v, symbols=symbols(v)).get_module_context("Brand#13")["types"]


@query(ORACLES["summary_text_search"])
def api_search_architecture(v: Views) -> DataFrame:
    found = served(v, files=v.files).search_architecture("All rights reserved")
    return found.select(F.col("place").alias("path"), F.substring("snippet", 1, 80).alias("head"), F.length("snippet").cast("long").alias("n"))


@query("""select distinct '' parent, source as "name", true is_dir from documents union select distinct source, lang, true from documents""")
def api_directory_tree(v: Views) -> DataFrame:
    return served(v, files=v.files).get_directory_tree(depth=2)


@query(ORACLES["token_template_match"])
def api_template_file(v: Views) -> DataFrame:
    return served(v, files=v.files).find_template_file("the page for andReheer shand src1/thention-shand")


@query(ORACLES["feature_keyword_rank"])
def api_feature_context(v: Views) -> DataFrame:
    f = v.table("customer").select(F.col("c_mktsegment").alias("id")).distinct()
    return served(v, features=f.withColumns({"name": F.col("id"), "description": F.concat(F.lit("customers of "), "id")})).get_feature_context("of Machinery house", 4)


@query("select * from (values ('verdict', 'string'), ('issues', 'array'), ('summary', 'string')) s(key, type)")
def api_artifact_schema(v: Views) -> DataFrame:
    return Knowledge(v.spark, folder(v)).get_artifact_schema("review")


@query("select false valid, 'missing summary,unknown verdict' errors, 'extra' warnings")
def api_validate_draft(v: Views) -> DataFrame:
    rows = Knowledge(v.spark, folder(v)).validate_artifact_draft("review", '{"verdict": "maybe", "extra": 1}')
    return rows.select("valid", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(ORACLES["explore_graph_both"])
def api_explore_graph(v: Views) -> DataFrame:
    e = v.contains.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("contains").alias("type"))
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    k = served(v, nodes=ends.withColumn("type", F.substring_index("id", ":", 1)), edges=e)
    return k.explore_graph("customer:1", ["contains"])[0].select("id", "depth")


@query(ORACLES["index_summary"])
def api_project_overview(v: Views) -> DataFrame:
    meta = v.spark.range(1).select(F.lit("standard").alias("richness"))
    one = served(v, symbols=symbols(v), files=v.files, meta=meta).get_project_overview()["index"]
    listed = F.array_join(F.transform(F.array_sort(F.map_keys("symbol_counts")), lambda k: F.concat(k, F.lit("="), F.col("symbol_counts")[k].cast("string"))), ",")
    return one.select("file_count", "symbol_count", listed.alias("types"))


@query(f"""with {SYMBOLS} select count(*) total, count(*) filter (where is_exported and type <> 'module-init') exported, count(*) filter (where type = 'function') functions,
count(*) filter (where type = 'class') classes, count(*) filter (where type = 'interface') interfaces from symbols""")
def api_code_patterns(v: Views) -> DataFrame:
    found = served(v, symbols=symbols(v), files=v.files).get_code_patterns()["structure"]
    return found.select("total", "exported", "functions", "classes", "interfaces")


@query(f"""with {FILES}, own as (select path, module, split_part(path, '/', 2) lang from files where ends_with(path, '/doc_3.txt'))
select f.path from files f join own on f.module = own.module and split_part(f.path, '/', 2) = own.lang where f.path <> own.path""")
def api_implementation_siblings(v: Views) -> DataFrame:
    return served(v, files=v.files, symbols=symbols(v)).get_implementation_context("doc_3.txt", snippets=False)["siblings"]


# --- sinks ------------------------------------------------------------------------------------


@query("""with f as (select distinct c_mktsegment id from customer) select 1::integer generation, id from f union all select 2::integer, id from f where id <> 'BUILDING'""")
def published_generations(v: Views) -> DataFrame:
    """Two generations of a table; the first can still be read when the second is current."""
    f = v.table("customer").select(F.col("c_mktsegment").alias("id")).distinct()
    k = served(v, features=f)
    k.store.publish({"features": filled(f.where("id <> 'BUILDING'"), TABLES["features"])})
    return k.store.table("features", 1).select(F.lit(1).alias("generation"), "id").unionByName(k.t("features").select(F.lit(2).alias("generation"), "id"))


@query(f"""with q as (select embedding e from embeddings order by vec_id limit 1),
rows as (select 'file:' || vec_id id, case when vec_id % 2 = 0 then list_reverse(embedding) else embedding end v from embeddings),
d as (select id, {L2.format(a="v", b="e")} distance from rows, q) select id, round(distance, 4) distance from d order by d.distance, id limit 10""")
def vector_upsert(v: Views) -> DataFrame:
    """Nearest rows after every second vector was put in again, reversed."""
    rows = v.table("embeddings").select(
        F.concat(F.lit("file:"), F.col("vec_id").cast("string")).alias("id"), F.lit("files").alias("scope"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "vec_id",
    )
    store = VectorStore(v.spark, folder(v))
    store.upsert(rows.drop("vec_id"))
    store.upsert(rows.where("vec_id % 2 = 0").withColumn("embedding", F.reverse("embedding")).drop("vec_id"))
    first = v.table("embeddings").orderBy("vec_id").select("embedding").first().embedding
    return store.search("files", list(first), 10).select("id", F.round("distance", 4).alias("distance"))
