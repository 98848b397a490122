"""Schemas of the knowledge tables; missing optional columns are null."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_PLAIN = {
    "string": StringType, "int": IntegerType, "bigint": LongType, "long": LongType, "boolean": BooleanType, "float": FloatType, "double": DoubleType, "timestamp": TimestampType,
}


def _parts(text: str) -> list[str]:
    """Text cut at the commas that no angle bracket holds."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def _type(text: str) -> DataType:
    name, _, inside = text.partition("<")
    inside = inside.rstrip()[:-1]
    if name == "array":
        return ArrayType(_type(inside))
    if name == "map":
        return MapType(*(_type(p) for p in _parts(inside)))
    if name == "struct":
        return StructType([StructField(n.strip(), _type(t.strip())) for n, _, t in (p.partition(":") for p in _parts(inside))])
    return _PLAIN[name]()


def ddl(text: str) -> StructType:
    """A schema from its DDL text, without a session (which modules can't count on when imported)."""
    return StructType([StructField(n, _type(t.strip())) for n, _, t in (" ".join(p.split()).partition(" ") for p in _parts(text))])

SYMBOLS = ddl(
    """name string, qualified_name string, file string, line int, signature string, type string, module string,
    calls array<string>, called_by array<string>, throws array<string>, is_exported boolean, language string, jsdoc string,
    parameters array<struct<name: string, type: string, description: string, optional: boolean, default_value: string>>,
    return_type string, decorators array<string>, complexity int, is_async boolean, access_modifier string, deprecation_notice string"""
)
FILES = ddl(
    """path string, purpose string, exports array<string>, dependencies array<string>, side_effects array<string>, throws array<string>,
    last_updated timestamp, content_hash string, detailed_purpose string,
    public_api array<struct<name: string, type: string, signature: string, jsdoc: string>>, internal_patterns array<string>,
    architectural_role string, complexity_score int, test_files array<string>, llm_description string"""
)
SOURCES = ddl("path string, content string")
IMPORTS = ddl("file string, dep string, is_dynamic boolean")
MODULE_EDGES = ddl("src string, dst string, type string")
NODES = ddl("id string, type string, metadata map<string, string>")
EDGES = ddl("source string, target string, type string")
FEATURES = ddl(
    """id string, name string, description string, files array<string>, entry_points array<string>, data_flow string,
    key_symbols array<string>, related_features array<string>"""
)
VECTORS = ddl("id string, scope string, embedding array<float>, metadata map<string, string>")

# Kinds of nodes and edges.
NODE_TYPES = ("file", "symbol", "module", "feature", "package")
EDGE_TYPES = ("calls", "imports", "depends_on", "contains", "implements", "similar_to")
