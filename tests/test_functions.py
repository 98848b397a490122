from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomry.functions import text as T
from fathomry.functions import vectors as V


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_terms(spark):
    rows = [("getUserName",), ("src/lib/cache.ts",), ("snake_case-kebab",), ("HTTPServer2",), ("  ",), (None,), ("Ñandú x",)]
    got = [r[0] for r in one(spark, "t string", rows, T.terms(F.col("t")))]
    assert got == [["get", "user", "name"], ["src", "lib", "cache", "ts"], ["snake", "case", "kebab"], ["httpserver2"], [], None, ["and", "x"]]


def test_template_terms(spark):
    assert one(spark, "t string", [("the Order-service for an Order",)], T.template_terms(F.col("t")))[0][0] == ["order", "service"]


@pytest.mark.parametrize(("name", "want"), [("order", 1.0), ("createOrder", 0.8 + 5 / 11 * 0.2), ("ord", 0.8 + 3 / 5 * 0.2), ("xrderx", 2 / 6), ("zz", 0.0)])
def test_closeness(spark, name, want):
    assert abs(float(one(spark, "n string", [(name,)], T.closeness(F.col("n"), "Order"))[0][0]) - want) < 1e-9


def test_paths(spark):
    rows = [("./a//b/c.ts",), ("/a/b.ts",), ("a/../b",), ("b.ts",), (r"a\b.ts",)]
    got = one(spark, "p string", rows, T.normal_path(F.col("p")), T.first_segment(F.col("p")), T.parent_name(F.col("p")), T.folder(F.col("p")), T.base_name(F.col("p")))
    assert [g[0] for g in got] == ["a/b/c.ts", "a/b.ts", None, "b.ts", "a/b.ts"]
    assert got[3][1:] == ("(root)", "", "", "b.ts")
    rel = one(spark, "p string", [("/r/a/b",), ("/r",), ("/x",), ("a/b",)], T.relative(F.col("p"), "/r/"))
    assert [r[0] for r in rel] == ["a/b", ".", "(external)", "a/b"]


def test_module_name(spark):
    rows = [("packages/a/src/x.ts",), ("apps/x.ts",), ("lib/y.ts",), ("z.ts",)]
    got = one(spark, "p string", rows, T.module_name(F.col("p"), ["packages/*", "apps"], "proj"))
    assert [g[0] for g in got] == ["packages/a", "apps", "lib", "proj"]


def test_hashes(spark):
    d = one(spark, "a array<string>", [(["b", "a"],), (["a", "b"],)], T.set_digest(F.col("a")))
    assert d[0] == d[1]
    h = one(spark, "c string", [("x",)], T.content_hash(F.col("c")), T.content_hash(F.col("c"), F.lit("rich")), T.short_hash(F.col("c")))[0]
    assert h[0] != h[1] and h[0].startswith(h[2]) and len(h[2]) == 16


def test_display(spark):
    now = datetime(2024, 1, 10)
    rows = [(datetime(2024, 1, 9, 23, 59, 30),), (datetime(2024, 1, 9, 23, 59),), (datetime(2024, 1, 9, 20),), (datetime(2024, 1, 1),), (None,)]
    got = one(spark, "t timestamp", rows, T.age(F.col("t"), F.lit(now)))
    assert [g[0] for g in got] == ["30 seconds ago", "1 minute ago", "4 hours ago", "9 days ago", "unknown age"]
    assert one(spark, "t string", [("abcdef",), ("abc",)], T.ellipsis(F.col("t"), 4), T.ellipsis(F.col("t"), 5, "...")) == [("abc…", "ab..."), ("abc", "abc")]
    doc = "/**\n * @param x y\n * Makes an order.\n */"
    assert one(spark, "t string", [(doc,)], T.doc_first_line(F.col("t")))[0][0] == "Makes an order."


def test_labels_and_roles(spark):
    rows = [("src/a.test.tsx", ""), ("src/Button.tsx", ""), ("a.css", ""), ("x/user-data.ts", ""), ("src/x.ts", "Routing of pages"), ("server.ts", None), ("a/lib/x.ts", ""), ("t/get-x.ts", "")]
    got = one(spark, "p string, q string", rows, T.file_labels(F.col("p"), F.col("q")), T.role(F.col("p")), T.is_test(F.col("p")))
    assert [g[0] for g in got] == [["testing"], ["component"], ["css"], ["data"], ["routing"], [], [], []]
    assert [g[1] for g in got][5:] == ["entry-point", "utility", "handler"]
    assert [g[2] for g in got] == [True] + [False] * 7


def test_test_sources(spark):
    rows = [("tests/a.test.ts",), ("pkg/test_x.py",), ("src/__tests__/b.spec.js",)]
    got = [set(g[0]) for g in one(spark, "p string", rows, T.test_sources(F.col("p")))]
    assert "src/a.ts" in got[0] and "pkg/x.py" in got[1] and "src/b.js" in got[2]


def test_lenient_object(spark):
    rows = [('Sure:\n```json\n{"name": "Pay", "n": 1}\n```',), ("no object",), ('{"name": broken',)]
    got = one(spark, "t string", rows, F.try_variant_get(T.lenient_object(F.col("t")), "$.name", "string"))
    assert [g[0] for g in got] == ["Pay", None, None]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])]
    a, b = F.col("a"), F.col("b")
    got = one(spark, "a array<float>, b array<float>", rows, V.dot(a, b), V.cosine(a, b), V.l2(a, b), V.most_moved(a, b))
    assert [g[0] for g in got] == [0.0, 25.0, 0.0]
    assert [round(g[1], 9) for g in got] == [0.0, 1.0, 0.0]
    assert [round(g[2], 6) for g in got] == [2.236068, 0.0, 1.414214]
    assert one(spark, "d double", [(1.0,)], V.search_score(F.col("d")), V.build_score(F.col("d")))[0] == (0.5, 0.0)
