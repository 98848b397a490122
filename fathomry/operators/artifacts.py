"""Pipeline artifacts as JSON documents: schemas, validation, previews, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of each kind of artifact with their class of type, and those that may lack.
SCHEMAS = {
    "prd": {"title": "string", "overview": "string", "goals": "array", "requirements": "array", "constraints": "array", "acceptance_criteria": "array"},
    "architecture": {"components": "array", "data_flow": "array", "tech_decisions": "array", "constraints": "array", "directory_structure": "array"},
    "engineering_plan": {"strategy": "string", "implementation_order": "array", "risk_areas": "array", "testing_strategy": "object"},
    "tasks": {"tasks": "array"},
    "competitor_research": {"competitors": "array", "summary": "string", "competitive_advantages": "array", "market_gaps": "array"},
    "market_research": {
        "market_size": "object", "target_segments": "array", "approach": "string", "trends": "array", "timing_assessment": "object", "risks": "array", "recommendations": "array", "sources": "string",
    },
    "ux_spec": {
        "meta": "object", "design_system_reference": "object", "site_wide_enhancements": "array", "user_flows": "array", "screens": "array", "interactions": "array", "responsive_breakpoints": "array",
        "accessibility_requirements": "array", "data_architecture": "object", "component_hierarchy": "object", "seo_and_performance": "object", "testing_requirements": "array",
    },
    "field_specialist_review": {"domain": "string", "summary": "string", "findings": "array", "compliance_notes": "array", "risks": "array"},
    "devops": {"agent": "string", "project": "string", "date": "string", "status": "string", "summary": "string", "verification": "object"},
    "review": {"verdict": "string", "issues": "array", "summary": "string"},
    "feature_request": {"feature_request": "string"},
}
OPTIONAL = {
    "competitor_research": ("competitive_advantages", "market_gaps"),
    "market_research": ("approach", "trends", "timing_assessment", "risks", "recommendations", "sources"),
    "field_specialist_review": ("findings", "compliance_notes", "risks"),
    "review": ("issues",),
}
VERDICTS = ("pass", "fail", "pass_with_warnings", "approve", "reject", "request_changes")
PHASES = ("competitor_research", "user_psychology_research", "ux_specification", "prd", "architecture", "engineering_plan", "task_breakdown", "implementation")
ARTIFACT_OF = {"user_psychology_research": "market_research", "ux_specification": "ux_spec", "task_breakdown": "tasks", "implementation": "review"}
MAX_BYTES = 512 * 1024

#: Classes of JSON types by how ``schema_of_variant`` names them.
_CLASS = "case when s like 'ARRAY%' then 'array' when s like 'OBJECT%' then 'object' when s = 'STRING' then 'string' when s in ('BOOLEAN', 'VOID') then lower(s) else 'number' end"


def artifact_path(kind: str) -> str:
    return f"workspace/artifacts/{kind}.json"


def prior_phases(phase: str) -> list[str]:
    """Phases before a phase; none for the first or an unknown one."""
    return list(PHASES[: PHASES.index(phase)]) if phase in PHASES else []


def artifact_of(phase: str) -> str:
    return ARTIFACT_OF.get(phase, phase)


def validate(docs: DataFrame, kind: str, schema: dict[str, str] | None = None) -> DataFrame:
    """(id, valid, errors, warnings) of JSON drafts (id, json).

    Errors: no JSON object, too large, missing keys, keys of the wrong class; for architecture a
    directory_structure that isn't a flat array of strings; for review an unknown verdict.
    Warnings: keys that the schema doesn't ask for.
    """
    lacking = OPTIONAL.get(kind, ()) if schema is None else ()
    schema = SCHEMAS[kind] if schema is None else schema
    keys = sorted(schema)
    parsed = docs.select("id", "json", F.try_parse_json("json").alias("v"), F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")).alias("has"))
    typed = parsed.select("*", F.coalesce(F.schema_of_variant("v"), F.lit("")).alias("whole"))
    errors = [F.when(~F.col("whole").startswith("OBJECT"), F.lit("not a JSON object")), F.when(F.octet_length("json") > MAX_BYTES, F.lit("too large"))]
    for k in keys:
        there = F.array_contains("has", k)
        got = F.expr(_CLASS.replace("s ", f"schema_of_variant(try_variant_get(v, '$.{k}', 'variant')) ").replace("lower(s)", f"lower(schema_of_variant(try_variant_get(v, '$.{k}', 'variant')))"))
        if k not in lacking:
            errors.append(F.when(~there & F.col("whole").startswith("OBJECT"), F.lit(f"missing {k}")))
        errors.append(F.when(there & (got != schema[k]), F.concat(F.lit(f"{k} should be {schema[k]}, got "), got)))
    if kind == "architecture":
        kind_of = F.expr("schema_of_variant(try_variant_get(v, '$.directory_structure', 'variant'))")
        errors.append(F.when(F.array_contains("has", "directory_structure") & ~kind_of.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit("directory_structure must be a flat array of paths")))
    if kind == "review":
        errors.append(F.when(F.array_contains("has", "verdict") & ~F.coalesce(F.try_variant_get("v", "$.verdict", "string").isin(*VERDICTS), F.lit(False)), F.lit("unknown verdict")))
    known = F.array(*[F.lit(k) for k in keys if k not in lacking])
    found = typed.select("id", F.array_compact(F.array(*errors)).alias("errors"), F.array_sort(F.array_except("has", known)).alias("warnings"))
    return found.select("id", (F.size("errors") == 0).alias("valid"), "errors", "warnings")


def preview(docs: DataFrame, n: int = 10) -> DataFrame:
    """(id, pos, key, kind): the first ``n`` top-level keys of each JSON document."""
    keys = docs.select("id", F.try_parse_json("json").alias("v"), F.posexplode(F.slice(F.json_object_keys("json"), 1, n)).alias("pos", "key"))
    return keys.select("id", "pos", "key", F.schema_of_variant(F.expr("try_element_at(try_variant_get(v, '$', 'map<string, variant>'), key)")).alias("kind"))
