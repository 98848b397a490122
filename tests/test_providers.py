import pytest
from pyspark.sql import functions as F

from fathomry import providers, render
from fathomry.operators.vector_store import VectorStore
from fathomry.plans.catalog import within
from fathomry.sources import files


def test_respond():
    s = [render.Section("A", "x" * 50, 2), render.Section("B", "y" * 500, 1), render.Section("", "foot", render.FOOTER), render.Section("C", "z", 3)]
    text = render.respond(s, budget=100)
    assert text.startswith("A:\n") and "C:\nz" in text and "foot" in text and text.endswith("[1 section(s) left out: B; narrow the query]")
    assert render.respond([render.Section("", "a" * 40_000)], budget=50_000) == ""
    once = render.with_section("# T\n", "Graph", "n = 1")
    assert render.with_section(once, "Graph", "n = 1") == once


def test_lines(spark):
    f = spark.createDataFrame([("a.ts", "module", None, None, "p" * 120, ["x", "y", "z", "w"])], "path string, role string, llm_description string, detailed_purpose string, purpose string, exports array<string>")
    assert render.file_line(f).first().text == "a.ts [module]: " + "p" * 97 + "...\n  Exports: x, y, z"
    n = spark.createDataFrame([("file:a", "file", 1)], "id string, type string, depth int")
    assert render.lines(render.node_line(n)) == "  [file] a"
    e = spark.createDataFrame([("a", "b", "calls")], "source string, target string, type string")
    assert render.lines(render.edge_line(e)) == "a -calls-> b"
    g = spark.createDataFrame([("c", "Pay", "Pays", ["a", "b"])], "id string, name string, description string, files array<string>")
    assert render.lines(render.feature_line(g)) == "Pay: Pays (2 files)"


def test_registry(spark):
    r = providers.Registry.default()
    assert r.reader_of("a/b.PY") and r.reader_of("a.b/c") is None
    r.register((".sql",), lambda p, t: ([], [{"caller": p, "name": t.strip()}], []), ("target",))
    got = {x.path: [s.name for s in x.sites] for x in r.extract(spark.createDataFrame([("q.sql", "x "), ("n.txt", "y")], "path string, content string")).collect()}
    assert got == {"q.sql": ["x"], "n.txt": []} and "target" in r.skipped


def test_embedder_and_store(spark, tmp_path):
    provider = providers.HashedTerms(16)
    texts = spark.createDataFrame([("file:a", "pay order"), ("file:b", "send mail"), ("file:c", None)], "id string, text string")
    rows = providers.embedder(provider, batch=1)(texts).withColumns({"scope": F.lit("files"), "metadata": F.create_map(F.lit("k"), F.col("id"))})
    store = VectorStore(spark, str(tmp_path))
    assert store.all().count() == 0
    store.upsert(rows)
    store.upsert(rows.where("id = 'file:a'"))
    assert store.all("files").count() == 3 and store.describe().first().dimensions == 16
    best = store.search("files", provider.embed(["order pay"])[0], 1).collect()
    assert [(r.id, round(r.score, 6), r.metadata) for r in best] == [("file:a", 1.0, {"k": "file:a"})]
    store.remove(spark.createDataFrame([("file:a",)], "id string"))
    assert {r.id for r in store.all().collect()} == {"file:b", "file:c"}
    with pytest.raises(ValueError):
        store.search("odd", [0.0], 1)

    class Fails(providers.HashedTerms):
        def embed(self, texts):
            raise OSError

    assert providers.embedder(Fails(16), attempts=1)(texts).count() == 0


def test_prompts_and_answers(spark):
    f = spark.createDataFrame([("a.ts", "typescript", "code", "p", "d", None), ("b.ts", None, "more", "q", "e", None)], "path string, language string, content string, purpose string, detailed_purpose string, llm_description string")
    s = spark.createDataFrame([("run", "function", "run()", "a.ts", 1, "a.ts::run"), ("x", "class", None, "src/b.ts", 2, "src/b.ts::x")], "name string, type string, signature string, file string, line int, qualified_name string")
    asked = {r.path: r.prompt for r in providers.prompt(f, s, "rich").collect()}
    assert "- run (function): run()" in asked["a.ts"] and "llm_description" in asked["a.ts"] and "Symbols:\nnone" in asked["b.ts"]
    g = spark.createDataFrame([("c", ["a.ts", "b.ts"])], "id string, files array<string>")
    assert {r.qualified_name for r in providers.feature_symbols(g, s).collect()} == {"a.ts::run", "src/b.ts::x"}
    assert "- a.ts: p" in providers.feature_prompt(g, f, s).first().prompt
    answers = spark.createDataFrame([("a.ts", 'Here: {"purpose": "Pays", "llm_description": "short"}'), ("b.ts", "no")], "path string, answer string")
    got = {r.path: (r.purpose, r.llm_description) for r in providers.enriched(f, answers).collect()}
    assert got == {"a.ts": ("Pays", None), "b.ts": ("q", None)}


def test_query_log(spark):
    log = providers.QueryLog(clock=lambda: 1.0)
    assert log.run("find", {"a": 1}, lambda: "fine") == "fine"
    assert log.run("find", {}, lambda: 1 / 0).startswith("Error: find")
    log.run("find", {}, lambda: " "), log.run("find", {}, lambda: "Error: x")
    assert [r.kind for r in log.table(spark).collect()] == ["EXCEPTION", "EMPTY_RESULT", "ERROR"]


def test_config_names_and_paths(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"moduleRoots": ["packages/*"], "richness": "rich"}')
    assert files.read_config(spark, f"{tmp_path}/c.json") == {"roots": ["packages/*"], "richness": "rich", "exclude": []}
    assert files.read_config(spark, f"{tmp_path}/none.json") == {"roots": [], "richness": "standard", "exclude": []}
    m = spark.createDataFrame([('{"name": "shop", "main": "x.js"}',)], "content string")
    assert tuple(files.project_name(m, "/a/b").first()) == ("shop", "x.js") and tuple(files.project_name(m.where("1 = 0"), "/a/b/").first()) == ("b", None)
    assert files.safe_path(str(tmp_path), "c.json") and files.safe_path(str(tmp_path), "../x") is None


def test_timeout(spark):
    assert within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        within(spark, 2, lambda: spark.range(0, 10**11, 1, 8).selectExpr("sum(sqrt(id))").collect())
    assert within(spark, 60, lambda: spark.range(3).count()) == 3
