"""Text, path, hash and display functions on columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that template search leaves out.
STOPWORDS = [
    "a", "an", "the", "is", "are", "for", "to", "of", "in", "on", "with", "and", "or", "that", "this", "it", "as", "at", "by", "from", "be", "was",
    "has", "have", "do", "does", "did", "will", "would", "could", "should", "page", "file",
]


def terms(text: Column) -> Column:
    """Search terms: camel case, ``_ . / -`` and all but ASCII letters and digits separate; repeats stay."""
    apart = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda t: t != "")


def template_terms(text: Column) -> Column:
    """Distinct words of a description, without stopwords."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s/\-_]+"), lambda t: (t != "") & ~t.isin(STOPWORDS)))


def closeness(candidate: Column, query: str) -> Column:
    """Likeness of a name to a query, 0 to 1: equal, containing, or by shared trigrams."""
    q, c = query.lower(), F.lower(candidate)
    grams = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    longest = F.greatest(F.length(c), F.lit(len(q)))
    shared = F.when(
        F.length(c) >= 3,
        F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda k: F.substring(c, k, 3)), lambda t: t.isin(grams))),
    ).otherwise(0)
    return (
        F.when(longest == 0, F.lit(0.0))
        .when(c == q, F.lit(1.0))
        .when(c.contains(q) | F.lit(q).contains(c), 0.8 + F.least(F.length(c), F.lit(len(q))) / longest * 0.2)
        .otherwise(shared / longest)
    )


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ``./`` or ``/``; null if the path climbs out with ``..``."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"/\./", "/")
    p = F.regexp_replace(p, r"^(\./|/)+", "")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)"), p)


def relative(path: Column, root: str) -> Column:
    """A path below ``root``; ``.`` for the root, ``(external)`` elsewhere; relative paths stay."""
    root = root.rstrip("/")
    return (
        F.when(~path.startswith("/"), path)
        .when(path == root, F.lit("."))
        .when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1_000_000))
        .otherwise("(external)")
    )


def first_segment(path: Column) -> Column:
    """Module of a path: its first segment, or ``(root)``."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file; empty at the root."""
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.when(F.size(parts) > 1, F.size(parts) - 1)), F.lit(""))


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_name(path: Column, roots: list[str], project: str) -> Column:
    """Module by the first configured root that fits (``*`` stands for one segment), else the
    first segment, else the project's name."""
    out = None
    for root in roots:
        segments = root.strip("/").split("/")
        pattern = "^(" + "/".join("[^/]+" if s == "*" else quoted(s) for s in segments) + ")/"
        fit = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1))
        out = fit if out is None else F.coalesce(out, fit)
    rest = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(project)
    return rest if out is None else F.coalesce(out, rest)


def quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


def content_hash(text: Column, richness: Column | None = None) -> Column:
    return F.sha2(text if richness is None else F.concat(text, richness), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def set_digest(ids: Column) -> Column:
    """Digest of a set of ids, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(ids), "\x00"), 256)


def ellipsis(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(mark)), F.lit(mark))).otherwise(text)


def age(then: Column, now: Column) -> Column:
    """``5 minutes ago`` and the like; ``unknown age`` for null."""
    s = F.when(then.isNotNull() & now.isNotNull(), F.greatest(F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / 1000), F.lit(0)))
    out = F.lit("unknown age")
    for size, name in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day")):
        n = F.floor(s / size)
        word = F.when(n == 1, F.lit(name)).otherwise(name + "s")
        out = F.when(s >= (size if size > 1 else 0), F.concat(n.cast("string"), F.lit(" "), word, F.lit(" ago"))).otherwise(out)
    return out


def doc_first_line(doc: Column) -> Column:
    """First line of a doc comment that says something and is no tag."""
    lines = F.transform(F.split(F.regexp_replace(doc, r"^\s*/\*+|\*+/\s*$", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*+\s?", "")))
    return F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), F.lit(1))


def test_sources(path: Column) -> Column:
    """Paths of sources that a test file may belong to, most likely first."""
    plain = F.regexp_replace(path, r"\.(test|spec)\.([jt]sx?)$", ".$2")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(^|/)test_([^/]+\.py)$", "$1$2"), r"_test\.(py|go|dart)$", ".$1")
    homes = [plain, F.regexp_replace(plain, "(^|/)tests?/", "$1src/"), F.regexp_replace(plain, "(^|/)__tests__/", "$1"), F.regexp_replace(plain, "^tests?/", "")]
    return F.array_except(F.array_distinct(F.array(*homes)), F.array(path))


def is_test(path: Column) -> Column:
    return path.rlike(r"(\.(test|spec)\.[^/]*$)|((^|/)__tests__/)|((^|/)test_[^/]*\.py$)|(_test\.(py|go|dart)$)")


def is_sensitive(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)\.env|secret|credential|password|private[-_]?key|\.(pem|key|p12|pfx)$")


def is_data(path: Column) -> Column:
    return path.rlike(r"(-data\.[jt]s$)|(static-data)|((^|/)data/[^/]+\.(json|[jt]s)$)")


def role(path: Column) -> Column:
    """Architectural role by path."""
    name = base_name(path)
    return (
        F.when(name.isin("server.ts", "index.ts", "main.ts"), "entry-point")
        .when(path.contains("/lib/"), "utility")
        .when(name.rlike("^(get|find|search|health|validate)-"), "handler")
        .otherwise("module")
    )


def role_with_tests(path: Column) -> Column:
    return F.when(is_test(path), "test").otherwise(role(path))


def file_labels(path: Column, purpose: Column) -> Column:
    """All pattern labels of a file: testing, component, css, data, routing."""
    test = path.rlike(r"\.(test|spec)\.")
    return F.array_compact(
        F.array(
            F.when(test, "testing"),
            F.when(path.rlike(r"\.(jsx|tsx)$") & ~test, "component"),
            F.when(path.rlike(r"\.css$"), "css"),
            F.when(path.rlike(r"-data\.[jt]s$|static-data"), "data"),
            F.when(path.rlike("route|router") | F.coalesce(F.lower(purpose).contains("routing"), F.lit(False)), "routing"),
        )
    )


def import_kind(dep: Column) -> Column:
    return F.when(dep.startswith("node:"), "node").when(dep.rlike(r"^\.{0,2}/"), "relative").otherwise("external")


def static_purpose(path: Column) -> Column:
    return F.concat(F.regexp_replace(base_name(path), r"\.[^.]+$", ""), F.lit(" module"))


def detected_patterns(content: Column, path: Column) -> Column:
    """Patterns of a source file: barrel, factory, singleton, adapter, middleware, test."""
    return F.array_compact(
        F.array(
            F.when(F.regexp_count(content, F.lit(r"export\s+(\*|\{[^}]*\})\s+from")) >= 3, "barrel"),
            F.when(content.rlike(r"\b(create|make|build)[A-Z]\w*\s*\(|Factory\b"), "factory"),
            F.when(content.rlike(r"getInstance\s*\(|static\s+instance\b"), "singleton"),
            F.when(content.rlike(r"\w+Adapter\b"), "adapter"),
            F.when(content.rlike(r"\breq\b.*\bres\b.*\bnext\b"), "middleware"),
            F.when(is_test(path), "test"),
        )
    )


def lenient_object(answer: Column) -> Column:
    """The JSON object in a model's answer, with or without a code fence; null if there is none."""
    return F.try_parse_json(F.regexp_extract(F.regexp_replace(answer, r"```(json)?", ""), r"(?s)\{.*\}", 0))
