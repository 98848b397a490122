import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.operators import artifacts, cluster, dashboards, graph, incremental, lookup, retrieval, search

SYMBOL = "name string, qualified_name string, file string, line int, type string, is_exported boolean, calls array<string>, called_by array<string>"


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        ("createOrder", "o.ts::createOrder", "o.ts", 3, "function", True, ["p.ts::charge", "a.ts::track"], []),
        ("Order", "o.ts::Order", "o.ts", 1, "interface", True, [], []),
        ("OrderStatus", "o.ts::OrderStatus", "o.ts", 2, "type", False, [], []),
        ("charge", "p.ts::charge", "p.ts", 5, "function", True, [], ["o.ts::createOrder"]),
        ("track", "a.ts::track", "a.ts", 7, "function", True, [], ["o.ts::createOrder", "n.ts::notify"]),
        ("notify", "n.ts::notify", "n.ts", 9, "function", False, ["a.ts::track", "gone::x"], []),
    ]
    return spark.createDataFrame(rows, SYMBOL)


def calls_of(symbols):
    return symbols.select(F.col("qualified_name").alias("caller"), F.explode("calls").alias("callee"))


def test_find_symbol(symbols):
    assert [r.name for r in lookup.find_symbol(symbols, "order").collect()] == ["Order", "OrderStatus", "createOrder"]
    assert [r.name for r in lookup.find_symbol(symbols, "order", kind="function").collect()] == ["createOrder"]
    assert lookup.find_symbol(symbols, "nothing").count() == 0
    assert [r.qualified_name for r in lookup.disambiguate(symbols, "charge").collect()] == ["p.ts::charge"]
    assert [r.name for r in lookup.closest(symbols.select("name"), "creatOrder").collect()][0] in ("createOrder", "Order")


def test_invert_and_search_calls(symbols):
    calls = calls_of(symbols)
    inverted = {r.callee: r.called_by for r in graph.invert_calls(calls, symbols).collect()}
    assert inverted == {"p.ts::charge": ["o.ts::createOrder"], "a.ts::track": ["n.ts::notify", "o.ts::createOrder"]}
    up = graph.call_search(calls, symbols, "a.ts::track").collect()
    assert [(r.qualified_name, r.depth, r.file) for r in up] == [("n.ts::notify", 1, "n.ts"), ("o.ts::createOrder", 1, "o.ts")]
    down = graph.call_search(calls, symbols, "n.ts::notify", direction="callees").collect()
    assert [(r.qualified_name, r.file, r.line) for r in down] == [("a.ts::track", "a.ts", 7), ("gone::x", "unknown", 0)]
    with pytest.raises(ValueError):
        graph.call_search(calls, symbols, "x", max_depth=11)


def test_bfs_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.bfs(e, start, 10).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.depth for r in graph.bfs(e, start, 2, "incoming").collect()} == {"a": 0, "b": 1}
    assert graph.bfs(e, start, 1, "both", limit=1).count() == 1


def test_typed_edges_and_dependencies(spark):
    rows = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("b", "c", True), ("a", "a", False)], "src string, dst string, is_dynamic boolean")
    e = graph.typed_edges(rows)
    assert {tuple(r) for r in e.collect()} == {("a", "b", "direct"), ("b", "c", "dynamic")}
    assert {tuple(r) for r in graph.dependency_search(e, "a", 5).collect()} == {("a", "b", "direct", 1), ("b", "c", "dynamic", 2)}


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in pairs:
                if a == todo[-1 if False else 0] and b not in reach[n]:
                    reach[n].add(b)
                    todo.append(b)
            todo.pop(0)
    found = {frozenset([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    return {tuple(sorted(c)) for c in found if len(c) > 1}


@pytest.mark.parametrize("limit", [graph.MAX_DRIVER_EDGES, 0])
def test_cycles(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "MAX_DRIVER_EDGES", limit)
    rng = random.Random(6)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(11)} | {("x", "y"), ("y", "x")}
    pairs = {p for p in pairs if p[0] != p[1]}
    got = graph.cycles(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()
    assert {tuple(r.members) for r in got} == brute_components(pairs)
    assert all(r.component == min(r.members) for r in got)


def test_resolve_and_merge(spark):
    m = lambda **kv: kv
    nodes = spark.createDataFrame(
        [("file:src/cache.ts", "file", m(path="src/cache.ts")), ("symbol:x::Run", "symbol", m(name="Run", qualifiedName="x::Run")), ("module:src", "module", {})], "id string, type string, metadata map<string,string>"
    )
    find = lambda s: sorted((r.id, r.tier) for r in graph.resolve_start(nodes, s).collect())
    assert find("module:src") == [("module:src", 1)] and find("src") == [("module:src", 2)] and find("cache.ts") == [("file:src/cache.ts", 3)]
    assert find("run") == [("symbol:x::Run", 4)] and find("cach") == [("file:src/cache.ts", 5)] and find("zz") == []
    edges = spark.createDataFrame([("file:src/cache.ts", "module:src", "contains")], "source string, target string, type string")
    raw = spark.createDataFrame([("1", None, None, "Function", "src/new.ts"), (None, "cache", None, "file", "src/cache.ts"), ("3", None, None, "odd", None)], "id string, name string, label string, type string, path string")
    new = graph.imported_node(raw)
    links = spark.createDataFrame([("1", "cache", "INVOKES"), ("1", "cache", "invokes"), ("cache", "module:src", "has"), ("1", "?", "odd")], "source string, target string, relation string")
    n, e = graph.merge_graph(nodes, edges, new, links)
    assert n.count() == 4
    assert {tuple(r) for r in e.collect()} == {("file:src/cache.ts", "module:src", "contains"), ("symbol:src/new.ts", "file:src/cache.ts", "calls"), ("symbol:src/new.ts", "?", "similar_to")}


def test_resolve_calls(spark):
    symbols = spark.createDataFrame([("f", "a.py", "a.py::f"), ("f", "b.py", "b.py::f"), ("g", "b.py", "b.py::g")], "name string, file string, qualified_name string")
    sites = spark.createDataFrame([("a.py::m", "a.py", "f"), ("c.py::m", "c.py", "f"), ("a.py::m", "a.py", "g"), ("a.py::m", "a.py", "nope")], "caller string, file string, name string")
    assert {tuple(r) for r in graph.resolve_calls(sites, symbols).collect()} == {("a.py::m", "a.py::f"), ("c.py::m", "a.py::f"), ("c.py::m", "b.py::f"), ("a.py::m", "b.py::g")}


def test_resolve_calls_without_homes(spark):
    symbols = spark.createDataFrame([("f", "a.py", "a.py::f"), ("f", None, "?::f"), ("g", None, "?::g"), ("f", "a.py", None), ("f", "a.py", "a.py::f")], "name string, file string, qualified_name string")
    sites = spark.createDataFrame([("a", "a.py", "f"), ("c", "c.py", "f"), ("d", "c.py", "g"), ("e", None, "f"), (None, "c.py", "f")], "caller string, file string, name string")
    far = {("c", "a.py::f"), ("c", "?::f"), ("c", None), (None, "a.py::f"), (None, "?::f"), (None, None)}
    assert {tuple(r) for r in graph.resolve_calls(sites, symbols).collect()} == {("a", "a.py::f"), ("a", None)} | far


@pytest.mark.parametrize("held", [32_000_000, 0])
def test_callee_digests(spark, monkeypatch, held):
    """Both ways (names held by workers, pairs) against the pairs of a plain search; names shared by definitions count once."""
    monkeypatch.setattr(graph, "MAX_BROADCAST_BYTES", held)
    defs = [(f"n{i % 5}", None if i % 11 == 0 else f"f{i % 7}", None if i % 13 == 0 else f"q{i % 60}\u00e4" * (1 + i % 3)) for i in range(200)] + [("lost", None, "q"), ("nil", "f0", None)]
    calls = [(None if i % 17 == 0 else f"c{i % 40}", None if i % 19 == 0 else f"f{i % 9}", f"n{i % 6}") for i in range(300)] + [("only", "f0", "lost"), ("nils", "f0", "nil"), ("same", "f1", "n1"), ("again", "f1", "n1")]
    found: dict = {}
    for caller, file, name in calls:
        own = [d for d in defs if d[0] == name]
        near = [d for d in own if d[1] == file]
        if file is not None and any(d[1] is not None for d in own):
            found.setdefault(caller, set()).update(d[2] for d in near or own)
    want = set()
    for caller, callees in found.items():
        texts = sorted(x.encode() for x in callees if x is not None)
        want.add((caller, len(texts), hashlib.sha256(b",".join(texts)).hexdigest() if texts else None))
    symbols = spark.createDataFrame(defs, "name string, file string, qualified_name string")
    got = graph.callee_digests(spark.createDataFrame(calls, "caller string, file string, name string"), symbols).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("find", ["resolve_calls", "callee_digests"])
def test_calls_of_a_common_name_make_no_pairs_to_drop(spark, find):
    """400 files define the same name and call their own: what is shuffled grows with the sites, not with sites times definitions."""
    n = 400
    symbols = spark.range(n).selectExpr("'run' name", "concat('f', id) file", "concat('f', id, '::run') qualified_name")
    sites = symbols.selectExpr("concat(file, '::main') caller", "file", "name")
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    sc.setJobGroup(f"common-{find}", "test")
    assert getattr(graph, find)(sites, symbols).count() == n
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(f"common-{find}") for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert stages and sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 20 * n


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "auth login auth"), ("b", "authService.login"), ("c", ""), ("d", None), ("e", " ".join(["auth"] * 10))], "doc_id string, text string")
    got = retrieval.bm25(docs, "auth", 10).collect()
    assert {r.doc_id for r in got} == {"a", "b", "e"} and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    index = retrieval.index_documents(docs)
    again = retrieval.bm25_indexed(index, "auth", 10).collect()
    assert [(r.doc_id, round(r.score, 9)) for r in again] == [(r.doc_id, round(r.score, 9)) for r in got]
    twice = {r.doc_id: r.score for r in retrieval.bm25(docs, "auth auth", 10).collect()}
    assert all(abs(twice[r.doc_id] - 2 * r.score) < 1e-9 for r in got)
    assert retrieval.bm25(docs, "!!", 3).count() == 0 and len(retrieval.bm25(docs, "auth", 1).collect()) == 1
    changed = retrieval.replace_documents(index, spark.createDataFrame([("a", "other")], "doc_id string, text string"))
    assert {r.doc_id for r in retrieval.bm25_indexed(changed, "auth", 10).collect()} == {"b", "e"} and changed.docs.count() == 5


def test_fusion(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 1), (2, "c", 3)], "ranking int, id string, rank int")
    assert {r.id: round(r.score, 9) for r in retrieval.fuse(rows).collect()} == {"a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 63, 9)}
    kw = spark.createDataFrame([("files:a", 3.0), ("files:b", 2.0), ("symbols:c", 1.0)], "id string, score double")
    v1 = spark.createDataFrame([("files:b", 0.1), ("files:z", 0.2)], "id string, distance double")
    v2 = spark.createDataFrame([("files:y", 0.01)], "id string, distance double")
    got = {r.id: r.source for r in retrieval.hybrid(kw, [v1, v2], 10, "files").collect()}
    assert got == {"files:a": "bm25", "files:b": "hybrid", "files:z": "vector", "files:y": "vector"}
    assert retrieval.hybrid(kw, [], 2).count() == 2


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("CreateOrder", ("exact_symbol", 0.95, "symbols")), ("a::b", ("exact_symbol", 0.95, "symbols")), ("how does paying work", ("feature_search", 0.8, "features")),
        ("callers of charge", ("graph_traversal", 0.7, "all")), ("what is the caller", ("hybrid", 0.75, "all")), ("payment flow", ("vector_search", 0.6, "all")),
    ],
)
def test_route(spark, query, want):
    r = spark.range(1).select(retrieval.route(F.lit(query)).alias("r")).select("r.*", retrieval.refined_scope(F.lit(None).cast("string"), F.col("r")).alias("own")).first()
    assert (r.strategy, round(float(r.confidence), 9), r.scope) == want
    assert r.own == (want[2] if want[1] >= 0.75 else "all")


def test_knn(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).astype("float32")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id int, embedding array<float>").repartition(3)
    d = np.sqrt(((m.astype(float) - m[5].astype(float)) ** 2).sum(1))
    assert [r.id for r in retrieval.knn(v, m[5].tolist(), 7).collect()] == np.argsort(d, kind="stable")[:7].tolist()
    queries = v.where("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    got = retrieval.knn_matrix(v, queries, 5).collect()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(retrieval.knn_matrix(v, queries, 5).collect()) == sorted(got)
    for q in range(4):
        want = np.argsort(np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(1)), kind="stable")[:5].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert 5 not in [r.id for r in retrieval.similar(v, 5, m[5].tolist()).collect()]


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4)
    rows = [(f"f{i:03d}", (centres[i % 4] + rng.normal(0, 0.02, 4)).tolist()) for i in range(80)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {r.id: r.cluster for r in cluster.kmeans(v, 4).collect()}
    assert len({tuple(sorted(i for i in got if got[i] == c)) for c in set(got.values())}) == 4
    assert all(got[f"f{i:03d}"] == got[f"f{i % 4:03d}"] for i in range(80))
    assert got == {r.id: r.cluster for r in cluster.kmeans(v.repartition(5), 4).collect()}
    few = {r.id: r.cluster for r in cluster.kmeans(v.limit(2), 4).collect()}
    assert sorted(few.values()) == [0, 1] and cluster.kmeans(v.where("1 = 0")).count() == 0
    assert [cluster.cluster_count(n) for n in (1, 18, 100, 5000)] == [3, 3, 8, 30]


def test_features_and_names(spark):
    f = cluster.features(spark.createDataFrame([("b", 0), ("a", 0), ("c", 1)], "id string, cluster int")).collect()
    assert {(r.id, r.name, tuple(r.files)) for r in f} == {("cluster-0", "Feature 1", ("a", "b")), ("cluster-1", "Feature 2", ("c",))}
    said = spark.createDataFrame([('{"name": "Pay"}',), ("oops",)], "a string").select(cluster.named(F.col("a"), F.lit(1), F.lit(3)).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in said] == [("Pay", "Cross-cutting feature involving 3 files"), ("Feature 2", "Cross-cutting feature involving 3 files")]


def test_context_windows(spark):
    text = "\n".join("hit" if k in (1, 5, 13, 30) else f"line {k}" for k in range(1, 31))
    got = search.context_windows(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string"), "HIT").orderBy("first").collect()
    assert [(r.doc_id, r["first"], r["last"], r.hits) for r in got] == [(1, 1, 8, 2), (1, 10, 16, 1), (1, 27, 30, 1)]
    assert got[0].snippet.split("\n")[0] == "hit" and len(got[0].snippet.split("\n")) == 8


def test_budget(spark):
    rows = spark.createDataFrame([([(2, 0, 60), (1, 1, 50), (3, 2, 45), (3, 3, 5)],)], "s array<struct<priority: int, ord: int, bytes: int>>")
    assert rows.select(search.within_budget(F.col("s"), 100).alias("t")).first().t == [1, 2, 3]


def test_dashboards(spark, symbols):
    s = dashboards.structure(symbols.withColumn("is_async", F.lit(None).cast("boolean"))).first()
    assert (s.total, s.exported, s.functions, s.interfaces, s.percent_exported, s.style) == (6, 4, 4, 1, 67, "functional")
    disk = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("x/lib/c.ts",), ("d.ts",)], "path string")
    known = spark.createDataFrame([("a.ts",), ("root/src/b.ts",), ("other/c.ts",)], "path string")
    assert [r.path for r in dashboards.coverage_gaps(disk, known).collect()] == ["d.ts", "x/lib/c.ts"]
    score = lambda g, st, e, r: spark.range(1).select(dashboards.readiness(F.lit(g), F.lit(st), F.lit(e), F.lit(r)).alias("x")).first().x
    assert score(0, 0, 0, "rich") == 100 and score(20, 20, 10, "minimal") == 10 and score(1, 1, 1, "standard") == 80
    deps = spark.createDataFrame([("sass",), ("@prisma/client",), ("typeorm",)], "dep string")
    assert dashboards.detected(deps, dashboards.ORMS).first().found == "prisma"
    lines = ["Found 7 go files", "Found 2 python files", "Symbols: 40 in 12ms", "Embeddings: 3 files, 10 symbols in 5ms", "Graphify: +1 node, +2 edges in 3ms", "Summaries: 6 generated (4 cached) in 8ms"]
    r, empty = dashboards.log_stats(spark.createDataFrame([("\n".join("[build-knowledge] " + x for x in lines),), ("12 files, 30 symbols",)], "log string")).collect()
    assert (r.symbols, r.symbols_ms, r.embedded_files, r.embedded_symbols, r.added_nodes, r.added_edges, r.nodes, r.summaries, r.cached, r.total_ms) == (40, 12, 3, 10, 1, 2, None, 6, 4, None)
    assert r.language_files == {"go": 7, "python": 2} and empty.symbols is None and empty.language_files == {}


def test_increments(spark, symbols):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("c", None)], "path string, content_hash string")
    assert {tuple(r) for r in incremental.changed(cur, old).collect()} == {("b", "changed")}
    assert [r.path for r in incremental.deleted(cur, old).collect()] == ["d"]
    left = {r.name: r for r in incremental.delete_files(symbols, spark.createDataFrame([("o.ts",)], "file string")).collect()}
    assert set(left) == {"charge", "track", "notify"} and left["charge"].called_by == [] and left["track"].called_by == ["n.ts::notify"]
    new = spark.createDataFrame([("notify", "n.ts::notify", "n.ts", 1, "function", True, ["p.ts::charge"], [])], SYMBOL)
    after = {r.name: r for r in incremental.apply_changes(symbols, new, spark.createDataFrame([], "file string")).collect()}
    assert after["charge"].called_by == ["n.ts::notify", "o.ts::createOrder"] and after["track"].called_by == ["o.ts::createOrder"]


def test_artifacts(spark):
    drafts = [
        (1, '{"components": [], "data_flow": [], "tech_decisions": [], "constraints": ["x"], "directory_structure": ["a"]}'),
        (2, '{"components": {}, "data_flow": [], "tech_decisions": [], "constraints": [], "directory_structure": [{"a": 1}], "more": 1}'),
        (3, "[1]"), (4, "broken"), (5, None),
    ]
    got = {r.id: r for r in artifacts.validate(spark.createDataFrame(drafts, "id int, json string"), "architecture").collect()}
    assert got[1].valid and not got[2].valid and got[2].warnings == ["more"] and len(got[2].errors) == 2
    assert not any(got[k].valid for k in (3, 4, 5))
    review = artifacts.validate(spark.createDataFrame([(1, '{"verdict": "pass"}'), (2, '{"verdict": "meh"}'), (3, '{"verdict": 1}')], "id int, json string"), "review", {"verdict": "string"})
    assert {r.id: r.valid for r in review.collect()} == {1: True, 2: False, 3: False}
    assert artifacts.prior_phases("prd") == ["competitor_research", "user_psychology_research", "ux_specification"] and artifacts.prior_phases("none") == []
    shown = artifacts.preview(spark.createDataFrame([("x", '{"a": 1, "b": [1], "c": {"d": 2}}')], "id string, json string"), 2).collect()
    assert [(r.pos, r.key) for r in shown] == [(0, "a"), (1, "b")]


def test_find_file(spark):
    f = spark.createDataFrame([("src/a.ts",), ("lib/a.ts",), ("b.js",), ("x/b.js.ts",)], "path string")
    assert [lookup.find_file(f, q).select("path").collect() for q in ("zz",)] == [[]]
    assert [lookup.find_file(f, q).first().path for q in ("a.ts", "src/a.ts", "lib/a", "b", "b.js")] == ["lib/a.ts", "src/a.ts", "lib/a.ts", "b.js", "b.js"]
    with pytest.raises(ValueError):
        lookup.find_files(f, [])
