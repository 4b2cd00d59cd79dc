"""The domain's fixed values."""

from __future__ import annotations

# How much a relation weighs.
RELATION_WEIGHTS = {
    "calls_rpc": 24.0,
    "reads_table": 22.0,
    "writes_table": 24.0,
    "accesses_table": 20.0,
    "invokes_edge_function": 22.0,
    "overrides": 18.0,
    "extends": 16.0,
    "calls": 14.0,
    "imports": 9.0,
    "calls_sql": 22.0,
}
OTHER_RELATION_WEIGHT = 5.0
RESOURCE_RELATIONS = ["calls_rpc", "calls_sql", "reads_table", "writes_table", "accesses_table", "invokes_edge_function"]
CALLABLE_RELATIONS = ["calls_rpc", "calls_sql"]
TABLE_RELATIONS = ["reads_table", "writes_table", "accesses_table"]

# Source classes that retrieval and graphs look at, and their weights there and in propagation.
AUTHORITIES = ["code", "test", "schema_history", "generated", "config"]
RETRIEVAL_WEIGHTS = {"code": 1.0, "test": 0.9, "schema_history": 1.0, "config": 0.8, "generated": 0.65}
OTHER_RETRIEVAL_WEIGHT = 0.5
PROPAGATION_WEIGHTS = {"code": 1.0, "schema_history": 1.0, "test": 0.9, "config": 0.82, "generated": 0.62, "active": 0.55, "historical": 0.18, "unknown": 0.45}
CONFIDENCE_WEIGHTS = {"active_sql": 1.0, "exact_path": 1.0, "import_resolved": 0.95, "literal_via_wrapper": 0.95, "same_file": 0.9, "lexical": 0.72, "unresolved": 0.45}
STATUS_WEIGHTS = {"removed": 1.0, "added": 0.98, "modified": 1.0, "stable": 0.72}
DIRECTION_WEIGHTS = {"toward_dependency": 0.72, "toward_dependent": 1.0, "toward_resource": 0.9, "toward_consumer": 1.0}

# Kinds of symbols.
VERSIONED_KINDS = ["function", "view", "policy", "trigger", "type"]
DUPLICABLE_KINDS = ["function", "method", "class", "component", "hook"]

# Words that a question's terms leave out.
STOPWORDS = "a al and como con de del donde el en es esta este for how la las lo los of o para por que se the to un una y".split()
NOISE_WORDS = (
    "affected all automatic automatically compatibility complete code concrete date existing find identify implementation "
    "implement including manual relevant repository reversible selection trace where with"
).split()
GENERIC_SQL_TERMS = "configuration get kpi public set station summary update".split()

# Constants of ranking.
PATH_WEIGHT, CONTENT_WEIGHT = 2.5, 1.0
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6
FUSION_K, SEMANTIC_WEIGHT = 60, 0.9

# Constants of propagation.
RESTART, TOLERANCE, MOST_ROUNDS = 0.28, 1e-10, 80
HOP_DECAY = 0.78
WHOLE_FILE = (1, 1_000_000_000)
