"""What kind of source a path is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and suffixes by class.
MANIFESTS = ["package.json", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "makefile"]
CONFIG_PREFIXES = "tsconfig|jest\\.config|vitest\\.config|vite\\.config"
ROOT_DOCUMENTS = ["readme.md", "contributing.md", "code_of_conduct.md"]
CHANGE_LOGS = ["changelog.md", "history.md", "changes.md"]
TEST_FOLDERS = "test|tests|spec|specs|__tests__"
# The reasons that a file's row carries, which readers of the tables know.
REASONS = {
    "historical documents": "File under historical documentation",
    "generated": "Types generated from the Supabase schema",
    "schema_history": "SQL migration; only the latest same-name definition is active",
    "instructions": "Explicit repository instructions",
    "reference": "Architecture or reference document",
    "documentation": "Active project documentation",
    "config": "Executable configuration or project manifest",
    "root document": "Active documentation at the repository root",
    "change log": "Repository change history",
    "metadata": "Documentation or collaboration metadata",
    "test": "Executable test that fixes expected behavior",
    "code": "Current source code",
}


def source_class(path: Column) -> Column:
    """struct(authority, reason) of a path; the first rule that holds decides."""
    low = F.lower(path)
    name = F.element_at(F.filter(F.split(low, "/"), lambda x: x != ""), -1)
    name = F.coalesce(name, low)
    rules = [
        (low.contains("/history/") | low.startswith("docs/history/"), "historical", "historical documents"),
        (low.endswith("src/integrations/supabase/types.ts"), "generated", "generated"),
        (low.startswith("migrations/") | low.contains("/migrations/"), "schema_history", "schema_history"),
        (low.endswith("agents.md"), "canonical", "instructions"),
        (low.rlike("^docs/(architecture|reference)/"), "canonical", "reference"),
        (low.startswith("docs/"), "active", "documentation"),
        (name.isin(MANIFESTS) | name.rlike(f"^({CONFIG_PREFIXES})"), "config", "config"),
        (name.isin(ROOT_DOCUMENTS), "active", "root document"),
        (name.isin(CHANGE_LOGS), "historical", "change log"),
        (name.rlike(r"\.(md|rst)$") | low.rlike(r"^/*\.github(/|$)"), "active", "metadata"),
        (low.rlike(f"(^|/)({TEST_FOLDERS})/+[^/]") | name.rlike(r"[._](test|spec)\."), "test", "test"),
    ]
    out = F.struct(F.lit("code").alias("authority"), F.lit(REASONS["code"]).alias("reason"))
    for holds, authority, reason in reversed(rules):
        out = F.when(holds, F.struct(F.lit(authority).alias("authority"), F.lit(REASONS[reason]).alias("reason"))).otherwise(out)
    return out


# What marks a test's path, and layers by suffix.
TEST_MARKS = ["/test/", "/tests/", "__tests__", ".test.", ".spec.", "_test."]
LAYERS = {"database": [".sql"], "python": [".py"], "application": [".ts", ".tsx", ".js", ".jsx"]}


def is_test(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path))
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | low.contains(mark)
    return out


def layer(path: Column) -> Column:
    """test, database, python or application; else the suffix, or unknown."""
    suffix = F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)
    out = F.when(is_test(path), "test")
    for name, suffixes in LAYERS.items():
        out = out.when(suffix.isin(suffixes), name)
    return out.when(suffix != "", suffix).otherwise("unknown")


def resource_family(relation: Column, edge_function: str = "edge_function") -> Column:
    return F.when(relation.endswith("_table"), "table").when(relation.isin("calls_rpc", "calls_sql"), "callable").otherwise(edge_function)


def shareable(relation: Column, target: Column, resolution: Column | None = None) -> Column:
    """Whether a resource edge names a resource that others can name too. With ``resolution``, SQL calls must be linked."""
    public = target.startswith("public.")
    linked = public if resolution is None else public & (resolution == "active_sql")
    return F.coalesce(
        F.when(relation.endswith("_table") | (relation == "calls_rpc"), public).when(relation == "calls_sql", linked).otherwise((relation == "invokes_edge_function") & (target != "")), F.lit(False)
    )
