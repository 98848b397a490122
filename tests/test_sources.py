import json

import pytest
from pyspark.sql import functions as F

from fathomry.api import Knowledge
from fathomry.plans.catalog import Memory, Store, retried
from fathomry.sources import extract as E
from fathomry.sources import files

ORDER = """import { charge } from "../pay/pay";
import type { Item } from "./types.js";
const lazy = () => import("../notify/notify");
/** Creates orders. */
export class OrderService extends Base {
  private text = "class Fake {";
  // class Hidden {}
  constructor(private readonly pay: Pay) { super(); }
  async create(items: Item[], note = "x"): Promise<Order> {
    if (items.length && note) { throw new RangeError("empty"); }
    return charge(items.length);
  }
  get total(): number { return 1; }
}
export const audit = async (n: number): Promise<void> => { await track(n); };
function inner(a, b) { const helper = () => 1; for (const x of a) { helper(x ? 1 : 2); } }
export interface Shape { area: number }
export type Id = string;
export enum Kind { A, B }
inner([], 1);
"""
SAMPLES = {
    "src/orders/order.ts": ORDER,
    "src/orders/types.ts": "export interface Item { id: string }\n",
    "src/pay/pay.ts": "export function charge(n: number): number {\n  return n;\n}\n",
    "src/notify/notify.ts": "import { charge } from '../pay/pay';\nexport function notify() { charge(1); }\n",
    "src/pay/pay.test.ts": 'import { charge } from "./pay";\ncharge(2);\n',
    "node_modules/x/index.js": "export function no() {}\n",
    ".hidden/y.ts": "export function no() {}\n",
    "py/service.py": "from .store import Store\nimport os\n\nclass Service(Base):\n    @property\n    def name(self) -> str:\n        return self._n\n    def __init__(self, n: int = 1):\n        self._n = Store(n)\n    async def run(self, *, k=2):\n        raise ValueError('x')\n\ndef make(n):\n    def deep():\n        return 1\n    return Service(n) if n and n > 1 else None\n",
    "py/store.py": "class Store:\n    pass\n",
    "py/broken.py": "def ok(a):\n    return (\nclass Half(:\n    def m(self):\n        pass\n",
    "README.md": "# Project\nOrders are created here.\n",
}


def symbols(path, text):
    return {s["qualified_name"].split("::")[1]: s for s in E.read_file(path, text)[0]}


def test_typescript():
    s = symbols("src/o.ts", ORDER)
    assert {k: v["type"] for k, v in s.items()} == {
        "lazy": "function", "OrderService": "class", "OrderService.constructor": "constructor", "OrderService.create": "method", "OrderService.get:total": "method",
        "audit": "function", "inner": "function", "Shape": "interface", "Id": "type", "Kind": "enum",
    }
    assert s["OrderService"]["jsdoc"] == "/** Creates orders. */" and s["OrderService"]["line"] == 5
    create = s["OrderService.create"]
    assert create["is_async"] and create["complexity"] == 3 and create["throws"] == ["RangeError"] and create["return_type"] == "Promise<Order>"
    assert [(p["name"], p["type"], p["optional"]) for p in create["parameters"]] == [("items", "Item[]", False), ("note", None, True)]
    assert s["audit"]["is_async"] and s["audit"]["is_exported"] and not s["inner"]["is_exported"] and s["inner"]["complexity"] == 3
    sites = {(c["caller"].split("::")[-1], c["name"]) for c in E.read_file("src/o.ts", ORDER)[1]}
    assert {("OrderService.create", "charge"), ("audit", "track"), ("<module-init:src/o.ts>", "inner"), ("inner", "helper")} <= sites


def test_python():
    s = symbols("py/service.py", SAMPLES["py/service.py"])
    assert {k: v["type"] for k, v in s.items()} == {"Service": "class", "Service.name": "property", "Service.__init__": "constructor", "Service.run": "method", "make": "function"}
    assert s["Service.__init__"]["is_exported"] and s["Service.run"]["is_async"] and s["Service.run"]["throws"] == ["ValueError"]
    assert s["make"]["complexity"] == 3 and s["Service"]["signature"] == "class Service(Base)"
    assert set(symbols("b.py", SAMPLES["py/broken.py"])) == {"ok", "Half", "Half.m"}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.go", 'package a\nfunc (s *Srv) Run(n int) error {\n\treturn go1(n)\n}\nfunc init() {}\nfunc helper[T any](x T) {}\ntype Srv struct {\n\tN int\n}\ntype I interface { F() }\ntype Id string\n', {"Srv.Run": ("method", True), "init": ("module-init", False), "helper": ("function", False), "Srv": ("class", True), "I": ("interface", True), "Id": ("type", True)}),
        ("A.java", "package a;\npublic class A {\n  @Override\n  public int run(String s) throws IOException {\n    return b(s);\n  }\n  A(int x) {\n  }\n  enum E { X }\n  private static <T> T make(T t) { return t; }\n}\npublic @interface Mark {}\n", {"A": ("class", True), "A.run": ("method", True), "A.A": ("constructor", False), "A.E": ("enum", False), "A.make": ("method", False), "Mark": ("decorator", True)}),
        ("k.kt", "data class P(val x: Int) {\n  fun a(): Int { return b() }\n}\nobject O {\n  private fun c() {}\n}\nsuspend fun String.ext(b: Int): String { return b }\ntypealias Q = Int\nannotation class Mark\nenum class Z { A }\ninterface I\n", {"P": ("class", True), "P.a": ("method", True), "O": ("class", True), "O.c": ("method", False), "ext": ("function", True), "Q": ("type", True), "Mark": ("decorator", True), "Z": ("enum", True), "I": ("interface", True)}),
        ("l.rs", "pub struct P {\n    x: i32,\n}\nimpl P {\n    pub fn new(x: i32) -> Self {\n        P { x }\n    }\n    fn go(&self) -> i32 { self.x }\n}\npub trait T {\n    fn a(&self);\n}\nmacro_rules! m { () => {} }\npub enum E { A }\ntype X = i32;\n", {"P": ("class", True), "P.new": ("constructor", True), "P.go": ("method", False), "T": ("interface", True), "T.a": ("method", False), "m": ("function", False), "E": ("enum", True), "X": ("type", False)}),
        ("s.swift", "public struct P {\n  init(x: Int) {\n  }\n  func a() -> Int {\n    return b()\n  }\n}\nprotocol Q {\n}\nextension P {\n  private func z() {}\n}\nenum E { case a }\n", {"P": ("class", True), "P.init": ("constructor", True), "P.a": ("method", True), "Q": ("interface", True), "P.z": ("method", False), "E": ("enum", True)}),
        ("d.dart", "class P {\n  int a() {\n    return b();\n  }\n  int get v => 1;\n  void _c() {}\n}\nvoid main() {\n  run();\n}\ntypedef F = int;\nmixin M {}\nenum E { a }\n", {"P": ("class", True), "P.a": ("method", True), "P.v": ("property", True), "P._c": ("method", False), "main": ("function", True), "F": ("type", True), "M": ("class", True), "E": ("enum", True)}),
    ],
)
def test_other_languages(path, text, want):
    assert {k: (v["type"], v["is_exported"]) for k, v in symbols(path, text).items()} == want


def test_signature_and_braces():
    assert E.signature("function f(a: { b: number }, c = () => { x }) : R { body }") == "function f(a: { b: number }, c = () => { x }) : R"
    assert E.net_braces('if (a) { "}" // }') == 1 and E.net_braces("} /* { */ }") == -2


def test_imports():
    specs = lambda path, text, **kv: [(i["spec"], i["is_dynamic"]) for i in E.read_file(path, text, **kv)[2]]
    assert specs("src/o.ts", ORDER) == [("../pay/pay", False), ("./types.js", False), ("../notify/notify", True)]
    assert specs("a.rs", "use crate::x::Y;\nmod z;\nuse std::io;\n") == [("crate::x::Y", False), ("z", False)]
    assert E.read_file("lib/a.dart", "import 'package:app/b.dart';\nimport 'dart:io';\n")[2][0]["candidates"] == ["lib/b.dart"]
    assert E.read_file("m/a.go", 'import (\n "mod/x/y"\n "fmt"\n)\n', go_module="mod")[2][0]["candidates"] == ["x/y/*.go"]


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    for path, text in SAMPLES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_reading_a_tree(spark, project):
    rows = {r.path: r.language for r in files.read_sources(spark, str(project)).collect()}
    assert rows == {p: ("python" if p.endswith(".py") else "typescript") for p in SAMPLES if p.endswith((".py", ".ts")) and not p.startswith((".", "node"))}
    assert set(files.read_sources(spark, str(project), ["py", "src/pay"]).select("path").toPandas().path) == {"src/orders/order.ts", "src/orders/types.ts", "src/notify/notify.ts"}
    listed = files.listing(spark, str(project)).select("path")
    assert {r.language for r in files.project_languages(listed).collect()} == {"typescript", "python"}
    tree = [(r.parent, r.name, r.is_dir) for r in files.file_tree(listed, 1).collect()]
    assert tree == [("", "py", True), ("", "src", True), ("", "README.md", False)]


def test_manifests(spark):
    m = spark.createDataFrame([(json.dumps({"dependencies": {"express": "1", "react": "2"}, "devDependencies": {"vite": "3"}}),), ("{}",)], "content string")
    stack = files.tech_stack(m)
    assert [tuple(r) for r in stack.collect()] == [("build", "vite"), ("framework", "react"), ("framework", "express")]
    assert files.project_kind(stack).first().kind == "backend"
    n, e = files.import_graph(spark.createDataFrame([('{"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b", "type": "calls"}]}',), ("broken",)], "json string"))
    assert n.count() == 1 and [tuple(r) for r in e.collect()] == [("a", "b", "calls")]


def test_missing_and_broken_artifacts(spark, tmp_path):
    schema = files.StructType.fromDDL("a int")
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "good.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [files.read_json(spark, f"{tmp_path}/{n}.json", schema).count() for n in ("none", "bad", "good")] == [0, 0, 2]
    assert files.read_table(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_regex_symbols(spark):
    got = {(r.name, r.type, r.is_exported) for r in E.regex_symbols(spark.createDataFrame([("a.ts", ORDER)], "path string, content string")).collect()}
    assert {("OrderService", "class", True), ("audit", "function", True), ("inner", "function", False), ("Shape", "interface", True), ("Id", "type", True)} <= got


def test_knowledge(spark, project, tmp_path):
    k = Knowledge(spark, str(tmp_path / "store"))
    assert k.rebuild_knowledge(str(project)) == 1
    called = {r.qualified_name: r.called_by for r in k.t("symbols").collect()}
    assert called["src/pay/pay.ts::charge"] == ["<module-init:src/pay/pay.test.ts>", "src/notify/notify.ts::notify", "src/orders/order.ts::OrderService.create"]
    assert {r.path: r.test_files for r in k.t("files").collect()}["src/pay/pay.ts"] == ["src/pay/pay.test.ts"]
    deps = {(r.file, r.dep, r.is_dynamic) for r in k.t("imports").collect()}
    assert ("src/orders/order.ts", "src/notify/notify.ts", True) in deps and ("src/orders/order.ts", "src/orders/types.ts", False) in deps and ("py/service.py", "py/store.py", False) in deps
    assert [r.name for r in k.find_symbol("order").collect()] == ["OrderService"]
    assert {r.qualified_name for r in k.find_callers("charge").collect()} >= {"src/notify/notify.ts::notify"}
    assert k.get_file_summary("pay").first().path == "src/pay/pay.ts"
    assert k.explore_graph("pay.ts", ["imports"], 1)[0].count() == 4
    with pytest.raises(ValueError):
        k.explore_graph("pay.ts", ["odd"])
    assert "file:src/pay/pay.ts" in {r.id for r in k.semantic_search("charge").collect()}
    assert k.semantic_search("charge") is k.semantic_search("charge") and k.memory.hits >= 1
    assert k.health_check().first().gaps == 0
    text = k.text_of_symbols("order")
    assert "Name: OrderService" in text and "Staleness: fresh" in text and k.text_of_symbols("chrage").startswith("No symbol matches")
    assert {r.path for r in k.get_batch_summaries(["pay", "store.py"]).collect()} == {"src/pay/pay.ts", "py/store.py"}
    assert k.get_module_context("src")["files"].count() == 5 and k.get_code_patterns()["structure"].first().classes == 4
    context = k.get_implementation_context("pay.ts")
    assert {r.file for r in context["imported_by"].collect()} == {"src/orders/order.ts", "src/notify/notify.ts", "src/pay/pay.test.ts"}
    assert "charge" in context["snippets"].first().snippet and k.search_architecture("pay module").first().source == 1
    assert [r.key for r in k.get_artifact_schema("tasks").collect()] == ["tasks"] and not k.validate_artifact_draft("tasks", "{}").first().valid
    assert k.get_cumulative_context("prd", str(tmp_path)).count() == 0 and k.get_directory_tree("src", 1).count() == 3
    before = [tuple(r) for r in k.t("symbols").orderBy("qualified_name").collect()]
    (project / "src/pay/pay.ts").write_text("export function refund(n: number): number {\n  return n;\n}\n")
    assert k.rebuild_knowledge(str(project), is_incremental=True) == 2
    names = {r.qualified_name: r.calls for r in k.t("symbols").collect()}
    assert "src/pay/pay.ts::refund" in names and "src/pay/pay.ts::charge" not in names and names["src/orders/order.ts::OrderService.create"] == []
    (project / "src/pay/pay.ts").write_text(SAMPLES["src/pay/pay.ts"])
    k.rebuild_knowledge(str(project), is_incremental=True)
    assert [tuple(r) for r in k.t("symbols").orderBy("qualified_name").collect()] == before
    for call in (lambda: k.get_project_overview(9), lambda: k.get_directory_tree("../x"), lambda: k.get_artifact_schema("odd"), lambda: k.semantic_search("x", k=99)):
        with pytest.raises(ValueError):
            call()


def test_vectors_and_features(spark, project, tmp_path):
    def embed(texts):
        return texts.select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000).cast("float")).alias("embedding"))

    k = Knowledge(spark, str(tmp_path / "store"))
    k.rebuild_knowledge(str(project), embed=embed)
    q = k.t("vectors").where("id = 'file:src/pay/pay.ts'").first().embedding
    assert k.semantic_search("charge", vector=q).first().source == "hybrid"
    assert k.get_feature_context("pay", vector=q).count() >= 1 and k.find_template_file("x", vector=q).first().id == "file:src/pay/pay.ts"
    assert k.get_implementation_context("pay.ts")["similar"].count() == 3
    assert k.find_symbol("charge", vector=q).count() == 1


def test_store_keeps_the_old_generation_when_a_build_fails(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    meta = spark.createDataFrame([(1, None, "rich", 0, "r")], "generation int, built timestamp, richness string, errors int, root string")
    assert s.generation == 0 and s.table("meta").count() == 0
    assert s.publish({"meta": meta}) == 1
    with pytest.raises(Exception):
        s.publish({"meta": meta.withColumn("errors", F.raise_error(F.lit("no")))})
    assert s.generation == 1 and s.table("meta").first().richness == "rich" and s.publish({"meta": meta}) == 2


def test_memory_and_retry():
    now = [0.0]
    m = Memory(size=2, seconds=10, clock=lambda: now[0])
    made = []
    get = lambda g, k: m.get(g, k, lambda: made.append(k) or k)
    get(1, "a"), get(1, "a"), get(1, "b"), get(1, "c"), get(1, "a")
    assert made == ["a", "b", "c", "a"]
    now[0] = 20.0
    get(1, "a")
    get(2, "a")
    assert made == ["a", "b", "c", "a", "a", "a"] and len(m.held) == 1
    waits, tries = [], []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert retried(fails, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
