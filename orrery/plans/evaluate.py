"""How well rankings find what samples say: retrieval, ripple, and the two-state lab."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.store import Store
from . import maps, reactive, twin
from .simulate import safe_path

RETRIEVAL = "id string, project string, question string, gold_paths array<string>"
RIPPLE = "id string, project string, question string, seed_paths array<string>, gold_paths array<string>"
CORPUS = "kind string, path string, text string"


def read_samples(spark: SparkSession, path: str, schema: str = RETRIEVAL, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a JSON-lines file; blank lines don't count."""
    rows = spark.read.schema(schema).json(path).where("id IS NOT NULL")
    rows = rows.where(where) if where else rows
    return rows.orderBy("id").limit(limit) if limit else rows


def materialise(corpus: DataFrame, folder: Path | str) -> int:
    """Writes the files of a corpus (rows of kind ``file``) below ``folder``; raises ValueError for unsafe paths."""
    count = 0
    for row in corpus.where("kind = 'file'").toLocalIterator():
        path = Path(folder) / safe_path(row["path"])
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(row["text"] or "", "utf-8")
        count += 1
    return count


def rankings(store: Store, sample: dict, method: str, limit: int) -> list[str]:
    """A sample's files by one method."""
    project, question, seeds = sample["project"], sample.get("question") or "", sample.get("seed_paths") or []
    if method == "retrieval":
        return list(dict.fromkeys(h.path for h in maps.retrieve(store, project, question, 5 * limit, "fast")[0]))[:limit]
    if method == "lexical":
        return reactive.lexical_ripple(store, project, seeds, limit, question)
    if method == "static":
        return reactive.static_ripple(store, project, seeds, limit, question)
    if method == "map":
        return reactive.mapped_ripple(store, project, seeds, question, limit)
    if method.startswith("ppr_"):
        found = reactive.impact_distribution(store, project, seeds, limit, variant=method.removeprefix("ppr_"), delta_text=question)
        return [c["path"] for c in found["candidates"]]
    if method == "hybrid":
        return reactive.hybrid_ripple(store, project, seeds, question, limit)
    raise ValueError(f"unknown method {method!r}")


def evaluate(store: Store, samples: list[dict], methods: list[str], k: int = 10) -> DataFrame:
    """method, samples, recall (at k), reciprocal_rank and all_found, averaged over samples."""
    ranked = [(m, s["id"], path, n) for m in methods for s in samples for n, path in enumerate(rankings(store, s, m, k), 1)]
    gold = [(s["id"], p) for s in samples for p in s["gold_paths"]] + [(s["id"], None) for s in samples if not s["gold_paths"]]
    spark = store.spark
    found = spark.createDataFrame(ranked, "method string, id string, path string, rank int")
    wanted = spark.createDataFrame(gold, "id string, path string")
    out = None
    for m in methods:
        own = R.retrieval_metrics(found.where(F.col("method") == m), wanted, "id", "path", k).withColumn("method", F.lit(m))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("samples"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("reciprocal_rank"), F.avg(F.col("all_found").cast("double")).alias("all_found"))


def translation_counts(results: dict[str, dict], gold: dict[str, list[str]]) -> dict[str, int]:
    """How many obligations there are (results by sample), how many meet a gold path, and how many candidates had no sink."""
    fields = {k: r["impact_field"] for k, r in results.items()}
    paths = {k: {o["candidate_path"] for o in f["obligations"]} for k, f in fields.items()}
    return {
        "samples": len(fields),
        "samples_with_obligations": sum(bool(p) for p in paths.values()),
        "obligations": sum(len(f["obligations"]) for f in fields.values()),
        "obligations_matching_gold": sum(len(p & set(gold.get(k, []))) for k, p in paths.items()),
        "candidates": sum(len(f["delta_core_candidates"]) for f in fields.values()),
        "candidates_without_sink": sum(len(f["ranked_candidates_without_supported_sink"]) for f in fields.values()),
    }


def score_case(delta: twin.Delta, expected: dict, k: int = 10) -> dict:
    """One lab case: how many expected changes and impact paths were found, over both states and over the changed one only."""
    views = {
        "file_changes": {(r["path"], r["change"]) for r in delta.files.collect()},
        "symbol_changes": {(r["path"], r["qualified_name"], r["change"]) for r in delta.symbols.collect()},
        "edge_changes": {(r["source_path"], r["relation"], r["target_name"], r["change"]) for r in delta.edges.collect()},
        "identity_candidates": {(r["before_qualified_name"], r["after_qualified_name"], r["change"]) for r in delta.identities.collect()},
    }
    wanted = [(view, tuple(item)) for view in views for item in expected.get(view, [])]
    both = [c["path"] for c in twin.impact_of_delta(delta, k)["candidates"]]
    seeds = delta.changed_paths()
    only = [c["path"] for c in twin.impact_of_snapshot(delta.changed, seeds, k)["candidates"]]
    paths = expected.get("impact_paths", [])
    missed = expected.get("current_only_miss_paths", [])
    return {
        "expected": len(wanted),
        "expected_found": sum(item in views[view] for view, item in wanted),
        "impact_paths": len(paths),
        "union_found": sum(p in both for p in paths),
        "current_found": sum(p in only for p in paths),
        "planned_misses": len(missed),
        "misses_confirmed": sum(p not in only and p in both for p in missed),
    }


def summarise(cases: list[dict]) -> dict[str, float]:
    """Recalls over all cases together, 4 places."""

    def share(a: str, b: str) -> float:
        total = sum(c[b] for c in cases)
        return round(sum(c[a] for c in cases) / total, 4) if total else 1.0

    return {"cases": len(cases), "delta_recall": share("expected_found", "expected"), "union_recall": share("union_found", "impact_paths"), "current_only_recall": share("current_found", "impact_paths"), "planned_misses_confirmed": share("misses_confirmed", "planned_misses")}
