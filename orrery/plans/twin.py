"""Two states of a repository: snapshots, their signed difference, and what a change may reach over both."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import graph as G
from ..operators import relational as L
from ..sources import ingest
from ..sources.store import StaleError, Store

FORMAT = 1
SYMBOL_KEY = ["path", "kind", "qualified_name", "occurrence"]
EDGE_KEY = ["source_path", "source_symbol", "relation", "target_name", "target_path", "target_symbol"]
TABLES = {
    "files": ["path", "authority", "reason", "content_digest"],
    "symbols": [*SYMBOL_KEY, "name", "start_line", "end_line", "signature", "active", "metadata", "body_digest", "shape_digest"],
    "edges": [*EDGE_KEY, "lines", "resolutions", "metadata"],
}


@dataclass
class Snapshot:
    """An immutable view of a structural index: header (project, commit, ..., digest and counts) and tables."""

    header: dict
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


@dataclass
class Delta:
    base: Snapshot
    changed: Snapshot
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    identities: DataFrame

    def changed_paths(self) -> list[str]:
        """Files whose content changed; without any, the paths of changed symbols and edges."""
        paths = self.files.select("path")
        if not paths.head(1):
            paths = self.symbols.select("path").unionByName(self.edges.select(F.col("source_path").alias("path")))
        return sorted(r[0] for r in paths.distinct().collect())


def canonical(raw: Column) -> Column:
    """A JSON object of strings with its keys sorted."""
    entries = F.array_sort(F.map_entries(F.from_json(raw, "map<string,string>")))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def _digest(rows: DataFrame, columns: list[str]) -> str:
    """SHA-256 over rows whatever their order, bucket by bucket."""
    own = rows.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("_h"))
    by = own.groupBy(F.substring("_h", 1, 2).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ","), 256).alias("_h")).orderBy("_b")
    return hashlib.sha256(json.dumps([[r["_b"], r["_h"]] for r in by.collect()]).encode()).hexdigest()  # at most 256 rows


def _counts(tables: dict[str, DataFrame]) -> dict:
    return {k: df.count() for k, df in tables.items()}


def _seal(header: dict, tables: dict[str, DataFrame]) -> dict:
    digest = hashlib.sha256(json.dumps({k: _digest(df, TABLES[k]) for k, df in tables.items()}, sort_keys=True).encode()).hexdigest()
    return header | {"format_version": FORMAT, "snapshot_digest": digest, "counts": _counts(tables)}


def capture(store: Store, project: str) -> Snapshot:
    """The current index as a snapshot. Raises StaleError if the checkout is newer, also while this runs."""
    status, manifest = store.require_current(project), store.manifest(project)
    spark, root = store.spark, store.registry.root(project)
    files = store.table(project, "files")
    names = [r[0] for r in files.select("path").orderBy("path").collect()]
    read = ingest.read_files(spark, root, names)
    state = files.join(read.select("path", F.sha2("content", 256).alias("content_digest")), "path", "left").withColumn("content_digest", F.coalesce("content_digest", F.sha2(F.lit("").cast("binary"), 256))).select(*TABLES["files"])
    symbols = L.numbered(store.table(project, "symbols"), SYMBOL_KEY[:3], ["start_line", "end_line", "id"], "occurrence").withColumn("active", F.col("active") == 1).withColumn("metadata", canonical(F.col("metadata")))
    # Undecodable bytes become replacement characters.
    texts = read.select("path", X.lines(F.make_valid_utf8(F.col("content").cast("string"))).alias("_lines"))
    length = F.greatest(F.col("start_line"), F.col("end_line")) - F.col("start_line") + 1
    source = F.coalesce(F.array_join(F.slice("_lines", F.greatest(F.lit(1), F.col("start_line")), length), "\n"), F.lit(""))
    body = F.when(F.col("_source") == "", "").otherwise(F.sha2("_source", 256))
    symbols = symbols.join(texts, "path", "left").withColumn("_source", source).withColumn("body_digest", body).withColumn("shape_digest", X.erased_shape(F.col("_source"), F.col("name"))).select(*TABLES["symbols"])
    symbol = F.when(F.coalesce("source_qualified_name", F.lit("")) != "", F.col("source_qualified_name")).otherwise(F.coalesce("source_name", F.lit("")))
    edges = store.table(project, "edges").select("source_path", symbol.alias("source_symbol"), "relation", "target_name", F.coalesce("target_path", F.lit("")).alias("target_path"), F.coalesce("target_qualified_name", F.lit("")).alias("target_symbol"), "line", "resolution_confidence", canonical(F.col("metadata")).alias("_meta"))
    edges = L.fact_groups(edges, EDGE_KEY, "line", {"resolutions": "resolution_confidence", "metadata": "_meta"}).select(*TABLES["edges"])
    tables = {"files": state.cache(), "symbols": symbols.cache(), "edges": edges.cache()}
    header = {"project": project, "commit": status["commit"], "generation_id": status["generation_id"], "extractor_version": manifest["extractor_version"], "graph_digest": manifest["graph_digest"]}
    sealed = _seal(header, tables)
    if store.status(project)["generation_id"] != status["generation_id"] or not store.status(project)["structural_current"]:
        raise StaleError("the checkout changed while its snapshot was taken")
    return Snapshot(sealed, **tables)


def save(snapshot: Snapshot, folder: Path | str) -> None:
    folder = Path(folder)
    for name in TABLES:
        snapshot.table(name).write.mode("overwrite").parquet(str(folder / name))
    (folder / "header.json").write_text(json.dumps(snapshot.header, indent=2, sort_keys=True), "utf-8")


def load(spark: SparkSession, folder: Path | str) -> Snapshot:
    """A saved snapshot. Raises ValueError unless its format, digest and counts are what the header says."""
    folder = Path(folder)
    header = json.loads((folder / "header.json").read_text("utf-8"))
    if header.get("format_version") != FORMAT:
        raise ValueError(f"unknown snapshot format {header.get('format_version')!r}")
    tables = {name: spark.read.parquet(str(folder / name)) for name in TABLES}
    sealed = _seal({}, tables)
    if any(sealed[k] != header.get(k) for k in ("snapshot_digest", "counts")):
        raise ValueError("the snapshot isn't what its header says")
    return Snapshot(header, **tables)


def to_json(snapshot: Snapshot) -> str:
    """The snapshot as one JSON text, for small repositories."""
    return json.dumps(snapshot.header | {name: [r.asDict(recursive=True) for r in snapshot.table(name).orderBy(*TABLES[name][:6]).collect()] for name in TABLES}, ensure_ascii=False, sort_keys=True)


def compare(base: Snapshot, changed: Snapshot) -> Delta:
    """The signed changes of files, symbols and edges, and pairs of symbols that may be one under another name or place."""
    if base.header["extractor_version"] != changed.header["extractor_version"]:
        raise ValueError("snapshots must come from the same extractor")
    files = L.snapshot_delta(base.files, changed.files, ["path"], ["authority", "reason", "content_digest"])
    kept = ["name", "shape_digest"]  # carried along, never a change of their own
    symbols = L.snapshot_delta(base.symbols, changed.symbols, SYMBOL_KEY, ["signature", "active", "metadata", "body_digest"], ["start_line", "end_line"])
    edges = L.snapshot_delta(base.edges, changed.edges, EDGE_KEY, ["resolutions", "metadata"], ["lines"])

    def side(snapshot: Snapshot, change: str) -> DataFrame:
        gone = symbols.where(F.col("change") == change).select(*SYMBOL_KEY)
        return snapshot.symbols.join(gone, SYMBOL_KEY, "left_semi").where("shape_digest <> ''").select(*SYMBOL_KEY, *kept)

    identities = L.rename_candidates(side(base, "removed"), side(changed, "added"), ["kind", "shape_digest"], "path", "name")
    return Delta(base, changed, files, symbols, edges, identities)


def union_steps(base: Snapshot, changed: Snapshot) -> DataFrame:
    """Weighted steps over the edges of both states: source, target, relation, direction, status, weight, evidence_path, lines."""
    payload = F.struct("resolutions", "metadata")
    one = base.edges.select(*EDGE_KEY, payload.alias("_old"), F.col("lines").alias("_old_lines"))
    two = changed.edges.select(*EDGE_KEY, payload.alias("_new"), F.col("lines").alias("_new_lines"))
    both = one.join(two, EDGE_KEY, "full_outer")
    status = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_new"), "modified").otherwise("stable")
    both = both.withColumn("status", status).withColumn("lines", F.coalesce("_new_lines", "_old_lines"))
    share = G.relation_weight(F.col("relation")) / max(V.RELATION_WEIGHTS.values()) * G.weight_of(F.col("status"), V.STATUS_WEIGHTS, 1.0)
    node = G.resource_node(F.col("relation"), F.col("target_name"))
    linked, public = F.col("target_path") != "", F.col("relation").isin(V.RESOURCE_RELATIONS) & C.shareable(F.col("relation"), F.col("target_name"))

    def step(a: Column, b: Column, direction: str, holds: Column) -> Column:
        weight = F.least(F.lit(1.0), share * V.DIRECTION_WEIGHTS[direction])
        return F.when(holds & (a != "") & (b != "") & (a != b), F.struct(a.alias("source"), b.alias("target"), F.lit(direction).alias("direction"), weight.alias("weight")))

    source, target = F.col("source_path"), F.col("target_path")
    steps = [step(source, target, "toward_dependency", linked), step(target, source, "toward_dependent", linked), step(source, node, "toward_resource", public), step(node, source, "toward_consumer", public)]
    return both.select("relation", "status", F.col("source_path").alias("evidence_path"), "lines", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("_s")).select("_s.*", "relation", "status", "evidence_path", "lines")


def _propagate(base: Snapshot, changed: Snapshot, seeds: list[str], limit: int, max_hops: int) -> dict:
    if limit < 1 or max_hops < 1:
        raise ValueError("limit and max_hops must be at least one")
    seeds = list(dict.fromkeys(seeds))
    if not seeds:
        raise ValueError("at least one changed path is needed")
    spark = base.files.sparkSession
    steps = union_steps(base, changed).cache()
    start = spark.createDataFrame([(s,) for s in seeds], "path string")
    labels = G.max_product(steps, start, max_hops).where(~F.col("node").isin(seeds) & ~F.col("node").startswith("@resource:"))
    states = changed.files.select(F.col("path").alias("node"), F.col("authority").alias("_new")).join(base.files.select(F.col("path").alias("node"), F.col("authority").alias("_old")), "node", "full_outer")
    rows = labels.join(states, "node", "left").orderBy(F.desc("score"), "node").limit(max(1, min(limit, 100))).collect()
    # Evidence for the steps of the paths shown: the heaviest edge between two nodes.
    pairs = sorted({(a, b) for r in rows for a, b in zip(r["path"], r["path"][1:])})
    best = {}
    if pairs:
        wanted = spark.createDataFrame(pairs, "source string, target string")
        order = W.partitionBy("source", "target").orderBy(F.desc("weight"), "relation", "status")
        found = steps.join(wanted, ["source", "target"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        best = {(r["source"], r["target"]): r.asDict() for r in found.collect()}
    both = base.edges.select(*EDGE_KEY).subtract(changed.edges.select(*EDGE_KEY)).limit(1).count() > 0
    return {
        "seed_paths": seeds,
        "candidates": [
            {"path": r["node"], "score": round(r["score"], 12), "authority": r["_new"] or r["_old"] or "unknown", "exists_in_base": r["_old"] is not None, "exists_in_changed": r["_new"] is not None, "strongest_path": [best[p] for p in zip(r["path"], r["path"][1:])]}
            for r in rows
        ],
        "algorithm": {"name": "max_product_union_graph", "hop_decay": V.HOP_DECAY, "max_hops": max_hops, "uses_removed_edges": both},
        "limits": {"candidate_is_not_a_required_edit": True, "graph_path_is_not_runtime_proof": True, "only_extracted_static_relations_are_propagated": True},
    }


def impact_of_delta(delta: Delta, limit: int = 20, max_hops: int = 4) -> dict:
    """What the changed files may reach over the edges of both states."""
    found = _propagate(delta.base, delta.changed, delta.changed_paths(), limit, max_hops)
    return found | {"base_snapshot": delta.base.header["snapshot_digest"], "changed_snapshot": delta.changed.header["snapshot_digest"]}


def impact_of_snapshot(snapshot: Snapshot, seeds: list[str], limit: int = 20, max_hops: int = 4) -> dict:
    """The same over one state only."""
    return _propagate(snapshot, snapshot, seeds, limit, max_hops)


def render(delta: Delta, impact: dict, most: int = 8) -> str:
    """A short text for a reviewer: what changed and what it may reach."""
    counts = {name: {r["change"]: r["count"] for r in getattr(delta, name).groupBy("change").count().collect()} for name in ("files", "symbols", "edges")}
    lines = ["REPOSITORY DELTA", "Structural evidence, no proof of behaviour.", f"Base: {delta.base.header['commit']}", f"Changed: {delta.changed.header['commit']}", f"Changed paths: {', '.join(impact['seed_paths'])}"]
    lines += [f"{name.capitalize()}: " + (", ".join(f"{n} {c}" for c, n in sorted(own.items())) or "unchanged") for name, own in counts.items()]
    lines += [f"  {r['change']}: {r['before_path']}::{r['before_qualified_name']} -> {r['after_path']}::{r['after_qualified_name']}" for r in delta.identities.orderBy("before_path", "before_qualified_name").limit(most).collect()]
    lines.append("IMPACT CANDIDATES")
    for item in impact["candidates"][:most]:
        where = "both states" if item["exists_in_base"] and item["exists_in_changed"] else "base only" if item["exists_in_base"] else "changed only"
        lines.append(f"  {item['path']} (score={item['score']:.6g}; {item['authority']}; {where})")
        lines += [f"    {s['source']} -> {s['target']} via {s['relation']} [{s['status']}]" for s in item["strongest_path"]]
    return "\n".join(lines)
