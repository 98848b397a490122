"""From source texts to symbols, call sites and imports.

One reader serves all languages with braces: strings and comments are blanked, declarations
are found by the language's patterns, bodies by their braces, and names by the bodies around
them.  Python is read with its own parser, or by indentation where that fails.  The readers
are regular-expression deep: they don't resolve types.

Each file is one row in and one row out, so extraction is a map without a shuffle.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .languages import GRAMMARS, language_of

_BRANCH = re.compile(r"\b(if|for|while|case|catch|when|guard|match)\b|&&|\|\||\?\?|\?(?![.?:])")
_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*)(\w+)\s*\(")
_SCHEMA = """path string, symbols array<struct<name: string, qualified_name: string, line: int, signature: string, type: string, is_exported: boolean,
jsdoc: string, decorators: array<string>, complexity: int, is_async: boolean, access_modifier: string, return_type: string,
parameters: array<struct<name: string, type: string, optional: boolean, default_value: string>>, throws: array<string>, deprecation_notice: string>>,
sites array<struct<caller: string, name: string>>, imports array<struct<spec: string, is_dynamic: boolean, ord: int, candidates: array<string>>>"""


def blanked(text: str, raw: tuple[str, ...] = (), single: bool = False, hash_comments: bool = False) -> str:
    """The text with strings and comments as blanks; places and line ends stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i) or (hash_comments and c == "#"):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
        elif quote := next((q for q in raw if text.startswith(q, i)), None):
            end = text.find(quote, i + len(quote))
            end = n if end < 0 else end + len(quote)
            blank(i + len(quote), end - len(quote))
        elif c == '"' or (c == "'" and single):
            end = i + 1
            while end < n and text[end] != c and text[end] != "\n":
                end += 2 if text[end] == "\\" else 1
            blank(i + 1, end)
            end += 1
        elif c == "'" and (m := re.match(r"'(?:\\.[^']{0,8}|[^'\\\n])'", text[i : i + 12])):
            end = i + m.end()
            blank(i + 1, end - 1)
        else:
            end = i + 1
        i = end
    return "".join(out)


def net_braces(line: str) -> int:
    """Braces opened less braces closed on a line, outside strings and comments."""
    plain = blanked(line, ("`",), True)
    return plain.count("{") - plain.count("}")


def signature(text: str) -> str:
    """Text up to the first brace outside brackets, on one line."""
    depth = 0
    for k, c in enumerate(text):
        if c == "{" and depth == 0:
            text = text[:k]
            break
        depth += (c in "([<{") - (c in ")]}" or (c == ">" and text[k - 1 : k] not in ("=", "-")))
        depth = max(depth, 0)
    return re.sub(r"\s+", " ", text).strip().rstrip(";,")


def _closing(text: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def split_parameters(inside: str, name_first: bool = False) -> list[dict]:
    out, depth, start = [], 0, 0
    parts = []
    for k, c in enumerate(inside):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and inside[k - 1 : k] not in ("=", "-")))
        if c == "," and depth <= 0:
            parts.append(inside[start:k])
            start = k + 1
    for p in [*parts, inside[start:]]:
        p = re.sub(r"\s+", " ", p).strip()
        if not p:
            continue
        body, _, default = p.partition("=") if "=>" not in p else (p, "", "")
        body = body.strip()
        name, colon, kind = body.partition(":")
        if not colon:
            words = body.split(" ")
            name, kind = (words[-1], " ".join(words[:-1])) if len(words) > 1 else (words[0], "")
            if name_first and len(words) > 1:
                name, kind = words[0], " ".join(words[1:])
        name = name.strip().split(" ")[-1]
        out.append({"name": name.rstrip("?").lstrip("*."), "type": kind.strip() or None, "optional": name.endswith("?") or bool(default), "default_value": default.strip() or None})
    return out


def _doc_before(text: str, at: int) -> tuple[str | None, list[str]]:
    """The doc comment and the decorators right above a declaration."""
    decorators: list[str] = []
    head = text[:at].rstrip()
    while True:
        line = head[head.rfind("\n") + 1 :].strip()
        if m := re.match(r"(?:@(\w[\w.]*)(?:\(.*\))?|#\[(.+)\])$", line):
            decorators.insert(0, m[1] or m[2])
            head = head[: head.rfind("\n") + 1].rstrip()
        else:
            break
    if head.endswith("*/") and (k := head.rfind("/**")) >= 0:
        return head[k:], decorators
    lines = []
    while (line := head[head.rfind("\n") + 1 :].strip()).startswith("///"):
        lines.insert(0, line[3:].strip())
        head = head[: head.rfind("\n") + 1].rstrip()
    return "\n".join(lines) or None, decorators


def _exported(language: str, name: str, mod: str) -> bool:
    if language in ("typescript", "javascript"):
        return "export" in mod
    if language == "go":
        return name[:1].isupper()
    if language == "rust":
        return "pub" in mod
    if language == "java":
        return "public" in mod
    if language == "dart":
        return not name.startswith("_")
    return not any(w in mod for w in ("private", "fileprivate", "internal" if language == "kotlin" else "private"))


def read_braces(path: str, text: str, language: str) -> tuple[list[dict], list[dict]]:
    """Symbols and call sites of a file."""
    g = GRAMMARS[language]
    plain = blanked(text, g.raw_strings, g.single_quotes)
    found: dict[int, tuple] = {}
    for d in g.declarations:
        for m in d.pattern.finditer(plain):
            name = m["name"]
            if name in g.keywords and d.kind != "constructor":
                continue
            if "ret" in m.re.groupindex and m["ret"] in g.keywords | {"new", "else", "return", "throw"}:
                continue
            found.setdefault(m.start("name"), (d, m))
    scopes: list[tuple[int, int, str]] = []
    bodies: list[tuple[int, int]] = []
    symbols, owners = [], []
    for at in sorted(found):
        d, m = found[at]
        around = [s for s in scopes if s[0] < at < s[1]]
        if any(a < at < b and not any(a < s[0] for s in around) for a, b in bodies):
            continue  # local to a function
        if d.inner and not around:
            continue
        name, mod = m["name"], (m["mod"] if "mod" in m.re.groupindex else "") or ""
        own = m.groupdict().get("owner")
        after = m.end()
        opening = plain.find("(", after) if d.kind in ("function", "method", "constructor") and plain[after:].lstrip()[:1] in ("(", "<", "[") else -1
        parameters = []
        if opening >= 0:
            close = _closing(plain, opening, "()")
            parameters = split_parameters(text[opening + 1 : close - 1], language == "go")
            after = close
        brace, stop = plain.find("{", after), re.compile(r";|\n[ \t]*\n|\n(?=[ \t]*(?:@|func |fun |def |pub |fn |class |export |public |private ))").search(plain, after)
        has_body = brace >= 0 and (stop is None or brace < stop.start())
        end = _closing(plain, brace) if has_body else (stop.start() if stop else len(plain))
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if d.scope and has_body:
            scopes.append((brace, end, name))
        elif has_body and d.kind not in ("interface", "type", "enum", "class"):
            bodies.append((brace, end))
        if d.kind == "scope":
            continue
        kind = d.kind
        if kind == "function" and around and language in ("kotlin", "rust", "swift", "dart"):
            kind = "method"
        if language == "rust" and kind == "method" and name == "new" and re.search(r"->\s*(Self|%s)\b" % re.escape(around[-1][2]), plain[after : brace if has_body else end]):
            kind = "constructor"
        if language == "go" and kind == "function" and name == "init":
            kind = "module-init"
        if re.search(r"\b(get|set)\s*$", mod) and kind == "method":
            name = f"{mod.split()[-1]}:{name}"
        chain = ".".join([*(s[2] for s in around), *([own] if own else []), name])
        body = plain[brace:end] if has_body else ""
        head = signature(text[start : brace if has_body else end])
        doc, decorators = _doc_before(text, start)
        returns = m.groupdict().get("ret") or (r[1].strip() if (r := re.search(r"\)\s*(?::|->)\s*([^={]+?)\s*(?:=>)?\s*(?:where\b.*)?$", head)) else None)
        if language == "go" and not returns and opening >= 0:
            returns = re.sub(r"\s+", " ", text[after:brace]).strip() or None if has_body else None
        access = next((w for w in ("private", "protected", "public", "internal", "fileprivate", "open") if re.search(rf"\b{w}\b", mod)), None)
        qualified = f"{path}::{chain}"
        symbols.append(
            {
                "name": name, "qualified_name": qualified, "line": text.count("\n", 0, start) + 1, "signature": head, "type": kind,
                "is_exported": _exported(language, name, mod) or any(o[1] for o in owners if around and o[0] == around[-1][2] and language in ("typescript", "javascript") and access in (None, "public")),
                "jsdoc": doc, "decorators": decorators, "is_async": bool(re.search(r"\b(async|suspend)\b", head)) or bool(re.match(r"[^=]*=\s*async\b", text[m.end() : m.end() + 80])), "access_modifier": access, "return_type": returns,
                "parameters": parameters, "complexity": 1 + len(_BRANCH.findall(body)) if kind in ("function", "method", "constructor", "module-init") else None,
                "throws": sorted(set(re.findall(r"\bthrow\s+(?:new\s+)?(\w+)", body))),
                "deprecation_notice": (re.search(r"@deprecated\s*(.*)", doc)[1].strip(" */") or "deprecated") if doc and "@deprecated" in doc else None,
            }
        )
        if d.scope:
            owners.append((name, symbols[-1]["is_exported"]))
        if body:
            bodies_of = (brace, end, qualified, kind)
            symbols[-1]["_body"] = bodies_of
    sites = []
    callers = [s["_body"] for s in symbols if "_body" in s and s["type"] in ("function", "method", "constructor", "module-init", "property")]
    for m in _CALL.finditer(plain):
        name = m[2]
        if name in g.keywords or m.start(2) in found:
            continue
        inside = [c for c in callers if c[0] < m.start() < c[1]]
        sites.append({"caller": inside[-1][2] if inside else f"<module-init:{path}>", "name": name})
    for s in symbols:
        s.pop("_body", None)
    return symbols, sites


def read_python(path: str, text: str) -> tuple[list[dict], list[dict]]:
    text = text.replace("\t", "    ")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _read_python_lines(path, text)
    symbols, sites = [], []

    def calls_of(node: ast.AST, caller: str) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    sites.append({"caller": caller, "name": name})

    def visit(body: list[ast.stmt], outer: list[str]) -> None:
        for n in body:
            if not isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                if not outer:
                    calls_of(n, f"<module-init:{path}>")
                continue
            chain = [*outer, n.name]
            qualified = f"{path}::{'.'.join(chain)}"
            is_class = isinstance(n, ast.ClassDef)
            decorators = [ast.unparse(d) for d in n.decorator_list]
            row = {
                "name": n.name, "qualified_name": qualified, "line": n.lineno, "is_exported": not n.name.startswith("_") or (n.name.startswith("__") and n.name.endswith("__")),
                "jsdoc": ast.get_docstring(n), "decorators": decorators, "is_async": isinstance(n, ast.AsyncFunctionDef), "access_modifier": None, "deprecation_notice": None,
                "throws": sorted({(r.exc.func if isinstance(r.exc, ast.Call) else r.exc).id for r in ast.walk(n) if isinstance(r, ast.Raise) and isinstance(r.exc.func if isinstance(r.exc, ast.Call) else r.exc, ast.Name)}),
            }
            if is_class:
                bases = ", ".join(ast.unparse(b) for b in n.bases)
                row |= {"type": "class", "signature": f"class {n.name}({bases})" if bases else f"class {n.name}", "parameters": [], "return_type": None, "complexity": None}
            else:
                a = n.args
                plain = [*a.posonlyargs, *a.args]
                defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
                every = [*zip(plain, defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]
                parameters = [
                    {"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None, "optional": d is not None, "default_value": ast.unparse(d) if d is not None else None}
                    for p, d in every
                    if not (outer and p is (plain[0] if plain else None) and p.arg in ("self", "cls"))
                ]
                returns = ast.unparse(n.returns) if n.returns else None
                shown = ", ".join(p["name"] + (f": {p['type']}" if p["type"] else "") + (f" = {p['default_value']}" if p["default_value"] else "") for p in parameters)
                branches = sum(isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)) for x in ast.walk(n)) + sum(len(x.values) - 1 for x in ast.walk(n) if isinstance(x, ast.BoolOp))
                kind = "constructor" if n.name == "__init__" and outer else "property" if "property" in decorators else "method" if outer else "function"
                row |= {
                    "type": kind, "signature": f"{'async ' if row['is_async'] else ''}def {n.name}({shown})" + (f" -> {returns}" if returns else ""),
                    "parameters": parameters, "return_type": returns, "complexity": 1 + branches,
                }
                for part in n.body:
                    calls_of(part, qualified)
            symbols.append(row)
            if is_class:
                visit(n.body, chain)

    visit(tree.body, [])
    return symbols, sites


def _read_python_lines(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """By lines and indentation, for texts that don't parse."""
    symbols, stack = [], []
    for k, line in enumerate(text.split("\n")):
        m = re.match(r"(\s*)(async\s+def|def|class)\s+(\w+)\s*(\([^)]*\))?", line)
        if not m:
            continue
        indent = len(m[1])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        chain = ".".join([*(n for _, n, _ in stack), m[3]])
        if not any(kind != "class" for _, _, kind in stack):
            is_class = m[2] == "class"
            symbols.append(
                {
                    "name": m[3], "qualified_name": f"{path}::{chain}", "line": k + 1, "signature": line.strip().rstrip(":"), "type": "class" if is_class else "method" if stack else "function",
                    "is_exported": not m[3].startswith("_"), "jsdoc": None, "decorators": [], "complexity": None if is_class else 1, "is_async": m[2].startswith("async"),
                    "access_modifier": None, "return_type": None, "parameters": [], "throws": [], "deprecation_notice": None,
                }
            )
        stack.append((indent, m[3], "class" if m[2] == "class" else "def"))
    return symbols, []


def imports_of(path: str, text: str, language: str, go_module: str = "") -> list[dict]:
    """Imports with the paths that each may mean, most likely first; packages outside have none."""
    here = posixpath.dirname(path)
    specs: list[tuple[str, bool, list[str]]] = []

    def near(spec: str, *endings: str) -> list[str]:
        p = posixpath.normpath(posixpath.join(here, spec))
        return [] if p.startswith("..") else [p + e for e in endings]

    if language in ("typescript", "javascript"):
        ends = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
        plain = re.sub(r"/\*.*?\*/|(?m:^\s*//.*$)", "", text, flags=re.S)
        for m in re.finditer(r"""(?:import|export)\s+(?:type\s+)?(?:[\w*{}\s,$]+?\s+from\s+)?["']([^"'\n]+)["']|\brequire\(\s*["']([^"'\n]+)["']\s*\)|\bimport\(\s*["']([^"'\n]+)["']\s*\)""", plain):
            spec = m[1] or m[2] or m[3]
            paths = near(spec, *ends) if spec.startswith(".") else []
            if spec.endswith((".js", ".jsx", ".mjs")):
                stem = spec.rsplit(".", 1)[0]
                paths += near(stem, ".ts", ".tsx") if spec.startswith(".") else []
            specs.append((spec, bool(m[3]), paths))
    elif language == "python":
        for m in re.finditer(r"(?m)^[ ]*(?:from\s+(\.*)([\w.]*)\s+import\s+\(?([\w, \n*]+)|import\s+([\w., ]+))", text):
            if m[4]:
                for name in (x.strip().split(" ")[0] for x in m[4].split(",")):
                    specs.append((name, False, [name.replace(".", "/") + e for e in (".py", "/__init__.py")]))
                continue
            dots, name = m[1] or "", m[2]
            base = name.replace(".", "/")
            up = "/".join([".."] * (len(dots) - 1))
            paths = near(posixpath.join(up or ".", base), ".py", "/__init__.py") if dots and base else [] if dots else [base + ".py", base + "/__init__.py"]
            if dots and not base:
                for part in re.findall(r"\w+", m[3]):
                    specs.append((dots + part, False, near(posixpath.join(up or ".", part), ".py", "/__init__.py")))
                continue
            specs.append((dots + name, False, paths))
    elif language == "go":
        for block in re.findall(r"(?m)^import\s+(?:\(([^)]*)\)|(?:\w+\s+)?(\"[^\"]+\"))", text):
            for spec in re.findall(r"\"([^\"]+)\"", block[0] or block[1]):
                inside = go_module and (spec == go_module or spec.startswith(go_module + "/"))
                specs.append((spec, False, [spec[len(go_module) :].strip("/") + "/*.go"] if inside else []))
    elif language in ("java", "kotlin"):
        ends = (".java",) if language == "java" else (".kt", ".java")
        for spec in re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?!\.?\*)\s*;?\s*(?:as\s+\w+)?$", text):
            if not spec.startswith(("java.", "javax.", "kotlin.", "kotlinx.", "android.")):
                tail = spec.replace(".", "/")
                specs.append((spec, False, [f"{root}{tail}{e}" for root in ("", "src/main/java/", "src/main/kotlin/", "src/", "app/src/main/java/") for e in ends]))
    elif language == "rust":
        for a, b in re.findall(r"(?m)^\s*(?:pub\s+)?(?:use\s+((?:crate|super|self)(?:::\w+)+)|mod\s+(\w+)\s*;)", text):
            spec = a or b
            stem = posixpath.splitext(posixpath.basename(path))[0]
            home = here if stem in ("mod", "lib", "main") else posixpath.join(here, stem)
            parts = spec.split("::")
            root = "src" if parts[0] == "crate" else posixpath.dirname(home) if parts[0] == "super" else home
            names = parts[1:] if a else parts
            paths = []
            for k in range(len(names), 0, -1):
                p = posixpath.normpath(posixpath.join(root or ".", *names[:k]))
                paths += [p + ".rs", p + "/mod.rs"]
            specs.append((spec, False, paths))
    elif language == "swift":
        specs.append(("(folder)", False, [posixpath.join(here, "*.swift")]))
    elif language == "dart":
        for spec in re.findall(r"(?m)^\s*(?:import|export|part)\s+['\"]([^'\"]+)['\"]", text):
            if spec.startswith("package:"):
                specs.append((spec, False, ["lib/" + spec.split("/", 1)[1]] if "/" in spec else []))
            elif not spec.startswith("dart:"):
                specs.append((spec, False, near(spec, "")))
    return [{"spec": s, "is_dynamic": d, "ord": k, "candidates": c} for k, (s, d, c) in enumerate(specs)]


def read_file(path: str, text: str, go_module: str = "") -> tuple[list[dict], list[dict], list[dict]]:
    language = language_of(path)
    if not language:
        return [], [], []
    symbols, sites = read_python(path, text) if language == "python" else read_braces(path, text, language)
    return symbols, sites, imports_of(path, text, language, go_module)


def extract(sources: DataFrame, go_module: str = "") -> DataFrame:
    """(path, symbols, sites, imports) of sources (path, content); null content counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [read_file(p, t or "", go_module) for p, t in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "symbols": [r[0] for r in rows], "sites": [r[1] for r in rows], "imports": [r[2] for r in rows]})

    return sources.select("path", "content").mapInPandas(run, _SCHEMA)


def symbols_of(extracted: DataFrame) -> DataFrame:
    from ..functions import text as T

    from .files import language_column

    s = extracted.select("path", F.explode("symbols").alias("s"))
    none = F.array().cast("array<string>")
    return s.select(F.col("path").alias("file"), T.parent_name(F.col("path")).alias("module"), language_column(F.col("path")).alias("language"), "s.*", none.alias("calls"), none.alias("called_by"))


def sites_of(extracted: DataFrame) -> DataFrame:
    """(caller, file, name), each once."""
    return extracted.select(F.col("path").alias("file"), F.explode("sites").alias("s")).select("s.caller", "file", "s.name").distinct()


def imports_found(extracted: DataFrame) -> DataFrame:
    """(file, dep, is_dynamic): the first candidate that is a file; a static import wins over a dynamic one.

    ``x/*.go`` stands for all files right in a folder.
    """
    cand = extracted.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.spec", "i.is_dynamic", "i.ord", F.posexplode("i.candidates").alias("k", "dep"))
    paths = extracted.select(F.col("path").alias("dep"))
    exact = cand.where(~F.col("dep").contains("*")).join(paths, "dep")
    w = Window.partitionBy("file", "ord").orderBy("k")
    first = exact.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file", "dep", "is_dynamic")
    folder = F.regexp_replace("dep", "/?[^/]*$", "")
    ending = F.substring_index("dep", ".", -1)
    wide = cand.where(F.col("dep").contains("*")).select("file", "is_dynamic", folder.alias("folder"), ending.alias("ending"))
    there = paths.select("dep", folder.alias("folder"), ending.alias("ending"))
    several = wide.join(there, ["folder", "ending"]).select("file", "dep", "is_dynamic")
    return first.unionByName(several).where("file != dep").groupBy("file", "dep").agg(F.bool_and("is_dynamic").alias("is_dynamic"))


def regex_symbols(sources: DataFrame) -> DataFrame:
    """(path, name, type, line, is_exported, is_async) of TypeScript and JavaScript by line patterns alone, in SQL."""
    lines = sources.select("path", F.posexplode(F.split("content", "\n")).alias("k", "raw")).select("path", (F.col("k") + 1).alias("line"), F.trim("raw").alias("l"))
    kinds = [
        ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("function", r"^export\s+const\s+(\w+)\s*=\s*(?:async\s+)?\("),
        ("class", r"^(?:export\s+(?:abstract\s+)?)?class\s+(\w+)"),
        ("interface", r"^export\s+interface\s+(\w+)"),
        ("type", r"^export\s+type\s+(\w+)"),
    ]
    hit = F.coalesce(*[F.when(F.col("l").rlike(p), F.struct(F.regexp_extract("l", p, 1).alias("name"), F.lit(k).alias("type"))) for k, p in kinds])
    found = lines.withColumn("h", hit).where("h is not null")
    return found.select("path", "h.name", "h.type", "line", F.col("l").startswith("export").alias("is_exported"), F.col("l").contains("async ").alias("is_async"))
