"""Rows as text: lines for each kind of row, sections within a byte budget, the footer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T

DEFAULT_BUDGET, HARD_CAP = 12_000, 32_000
#: Priority of the footer: it comes last, and goes first.
FOOTER = 99

# Byte budgets of endpoints that differ from the default.
BUDGETS = {
    "get_implementation_context": 20_000, "get_project_overview": 16_000, "get_cumulative_context": 24_000, "get_module_context": 14_000, "find_symbol": 14_000, "find_callers": 14_000,
    "get_batch_summaries": 14_000, "health_check": 14_000, "get_code_patterns": 14_000, "search_architecture": 14_000, "semantic_search": 14_000, "rebuild_knowledge": 16_000,
}


@dataclass(frozen=True)
class Section:
    label: str
    content: str
    priority: int = 1

    @property
    def block(self) -> str:
        return f"{self.label}:\n{self.content}" if self.label else self.content


def respond(sections: list[Section], endpoint: str = "", budget: int | None = None) -> str:
    """The sections that fit, by priority, then as given; a note names those left out.

    One that doesn't fit is skipped, and later ones may still fit.
    """
    left = min(budget or BUDGETS.get(endpoint, DEFAULT_BUDGET), HARD_CAP)
    shown, out = [], []
    for s in sorted(sections, key=lambda s: s.priority):
        need = len(s.block.encode()) + (2 if shown else 0)
        if need <= left:
            shown.append(s.block)
            left -= need
        elif s.label and s.priority < FOOTER:
            out.append(s.label)
    note = [f"[{len(out)} section(s) left out: {', '.join(out)}; narrow the query]"] if out else []
    return "\n\n".join([*shown, *note])


def footer(built: Column, now: Column, richness: Column, n_files: Column, stale: Column) -> Column:
    """One line on how old and complete the tables are."""
    flag = F.when(stale, "STALE, sources changed after the build").otherwise("fresh")
    return F.concat(F.lit("---\nIndex: built "), T.age(built, now), F.lit(" | Richness: "), richness, F.lit(" | Files indexed: "), n_files.cast("string"), F.lit(" | Staleness: "), flag)


def symbol_line(symbols: DataFrame) -> DataFrame:
    """(qualified_name, text) of symbols with what is known of them."""
    part = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{label}: "), c.cast("string")))
    lines = [
        part("Name", F.col("name")), part("Type", F.col("type")), part("File", F.concat("file", F.lit(":"), F.col("line").cast("string"))), part("Signature", F.col("signature")),
        part("Returns", F.col("return_type")), part("Exported", F.col("is_exported")), F.when(F.coalesce("is_async", F.lit(False)), F.lit("Async: true")), part("Access", F.col("access_modifier")),
        part("DEPRECATED", F.col("deprecation_notice")), part("Doc", T.doc_first_line(F.col("jsdoc"))),
        F.concat(F.lit("Callers: "), F.size("called_by").cast("string"), F.lit(", Callees: "), F.size("calls").cast("string")), part("Complexity", F.col("complexity")),
    ]
    return symbols.select("qualified_name", F.concat_ws("\n", *lines).alias("text"))


def file_line(files: DataFrame) -> DataFrame:
    """(path, text): path, role, shortened description and first exports."""
    said = T.ellipsis(F.coalesce("llm_description", "detailed_purpose", "purpose"), 100, "...")
    exports = F.when(F.size("exports") > 0, F.concat(F.lit("  Exports: "), F.array_join(F.slice("exports", 1, 3), ", ")))
    return files.select("path", F.concat_ws("\n", F.concat("path", F.lit(" ["), "role", F.lit("]: "), said), exports).alias("text"))


def node_line(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), "type", F.lit("] "), F.regexp_replace("id", "^[a-z]+:", "")).alias("text"))


def edge_line(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.concat("source", F.lit(" -"), "type", F.lit("-> "), "target").alias("text"))


def feature_line(features: DataFrame) -> DataFrame:
    return features.select("id", F.concat("name", F.lit(": "), "description", F.lit(" ("), F.size("files").cast("string"), F.lit(" files)")).alias("text"))


def lines(rows: DataFrame, limit: int = 50, column: str = "text") -> str:
    """The text of the first rows of a short, ordered list."""
    return "\n".join(r[0] for r in rows.select(column).limit(limit).collect())


MARKER = "<!-- imported graph -->"


def with_section(document: str, title: str, body: str) -> str:
    """A document with a marked section at its end; one that is there is replaced, so repeating changes nothing."""
    return f"{document.split(MARKER)[0].rstrip()}\n\n{MARKER}\n## {title}\n\n{body.strip()}\n"
