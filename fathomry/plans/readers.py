"""Registered queries of the source readers: a made file for each part, and the symbols that it holds by the language's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .queries import query
from .views import Views

#: By query: ending of the file, its text with NAME for the part's name, and its symbols (name, type, line, is_exported, names called).
MADE = {
    "extracted_typescript": (
        ".ts",
        "export class SNAME extends Base {\n  async run(n: number): Promise<number> {\n    return helper(n);\n  }\n}\nexport interface INAME { area: number }\nexport enum ENAME { A, B }\nfunction innerNAME(a) { return other(a); }\n",
        [("SNAME", "class", 1, True, ""), ("SNAME.run", "method", 2, True, "helper"), ("INAME", "interface", 6, True, ""), ("ENAME", "enum", 7, True, ""), ("innerNAME", "function", 8, False, "other")],
    ),
    "extracted_javascript": (
        ".js",
        "export function fNAME(a) {\n  return helper(a);\n}\nclass CNAME {\n  run() { return other(1); }\n}\n",
        [("fNAME", "function", 1, True, "helper"), ("CNAME", "class", 4, False, ""), ("CNAME.run", "method", 5, False, "other")],
    ),
    "extracted_go": (
        ".go",
        "package a\nfunc (s *SNAME) Run(n int) error {\n\treturn helper(n)\n}\nfunc inner(x int) {}\ntype SNAME struct {\n\tN int\n}\ntype INAME interface { F() }\n",
        [("SNAME.Run", "method", 2, True, "helper"), ("inner", "function", 5, False, ""), ("SNAME", "class", 6, True, ""), ("INAME", "interface", 9, True, "")],
    ),
    "extracted_java": (
        ".java",
        "package a;\npublic class SNAME {\n  public int run(String s) throws IOException {\n    return helper(s);\n  }\n  private static int make(int t) { return t; }\n  enum E { X }\n}\n",
        [("SNAME", "class", 2, True, ""), ("SNAME.run", "method", 3, True, "helper"), ("SNAME.make", "method", 6, False, ""), ("SNAME.E", "enum", 7, False, "")],
    ),
    "extracted_kotlin": (
        ".kt",
        "data class SNAME(val x: Int) {\n  fun a(): Int { return helper() }\n}\nobject ONAME {\n  private fun c() {}\n}\ninterface INAME\n",
        [("SNAME", "class", 1, True, ""), ("SNAME.a", "method", 2, True, "helper"), ("ONAME", "class", 4, True, ""), ("ONAME.c", "method", 5, False, ""), ("INAME", "interface", 7, True, "")],
    ),
    "extracted_rust": (
        ".rs",
        "pub struct SNAME {\n    x: i32,\n}\nimpl SNAME {\n    pub fn new(x: i32) -> i32 {\n        helper(x)\n    }\n    fn go(&self) -> i32 { self.x }\n}\npub trait TNAME {\n    fn a(&self);\n}\ntype XNAME = i32;\n",
        [("SNAME", "class", 1, True, ""), ("SNAME.new", "method", 5, True, "helper"), ("SNAME.go", "method", 8, False, ""), ("TNAME", "interface", 10, True, ""), ("TNAME.a", "method", 11, False, ""), ("XNAME", "type", 13, False, "")],
    ),
    "extracted_swift": (
        ".swift",
        "public struct SNAME {\n  init(x: Int) {\n  }\n  func a() -> Int {\n    return helper()\n  }\n}\nprotocol QNAME {\n}\nprivate func hNAME() {\n}\n",
        [("SNAME", "class", 1, True, ""), ("SNAME.init", "constructor", 2, True, ""), ("SNAME.a", "method", 4, True, "helper"), ("QNAME", "interface", 8, True, ""), ("hNAME", "function", 10, False, "")],
    ),
    "extracted_dart": (
        ".dart",
        "class SNAME {\n  int a() {\n    return helper();\n  }\n  void _c() {}\n}\nvoid main() {\n  other();\n}\nenum ENAME { a }\n",
        [("SNAME", "class", 1, True, ""), ("SNAME.a", "method", 2, True, "helper"), ("SNAME._c", "method", 5, False, ""), ("main", "function", 7, True, "other"), ("ENAME", "enum", 10, True, "")],
    ),
}


def read(v: Views, ending: str, text: str) -> DataFrame:
    """(qualified_name, type, line, is_exported, calls) of a file for each part."""
    from ..sources import extract

    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(ending))
    sources = v.table("part").select(path.alias("path"), F.replace(F.lit(text), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("content"))
    found = graph.scratch(extract.extract(sources), "extracted")
    calls = extract.sites_of(found).groupBy(F.col("caller").alias("qualified_name")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("called"))
    return extract.symbols_of(found).join(calls, "qualified_name", "left").select("qualified_name", "type", "line", "is_exported", F.coalesce("called", F.lit("")).alias("calls"))


def expected(ending: str, symbols: list[tuple[str, str, int, bool, str]]) -> str:
    rows = ", ".join(f"('{q}', '{kind}', {line}, {exported}, '{calls}')" for q, kind, line, exported, calls in symbols)
    return f"""select 'src/' || p_partkey || '{ending}::' || replace(q, 'NAME', replace(p_name, ' ', '')) qualified_name, type, line::integer line, is_exported, calls
from part, (values {rows}) s(q, type, line, is_exported, calls)"""


def _register(name: str, ending: str, text: str, symbols: list[tuple[str, str, int, bool, str]]) -> None:
    def run(v: Views) -> DataFrame:
        return read(v, ending, text)

    run.__name__ = name
    query(expected(ending, symbols))(run)


for _name, _made in MADE.items():
    _register(_name, *_made)
