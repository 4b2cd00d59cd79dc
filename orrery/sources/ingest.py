"""From a checkout's files to tables of files, chunks, symbols and edges."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import relational as L
from . import extract_python, extract_sql, extract_ts, git, ts_syntax

FILE_BITS = 20  # places for symbols and edges of one file in an id
ROWS = (
    "path string, ordinal long, place long, row string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, metadata string, "
    "source_name string, source_qualified_name string, relation string, target_name string, target_path string, target_qualified_name string, line int, found string, missing string, module string, relative boolean, candidates array<string>"
)
SYMBOL = ["id", "path", "kind", "name", "qualified_name", "start_line", "end_line", "signature", "metadata", "active"]
EDGE = ["id", "source_path", "source_name", "source_qualified_name", "relation", "target_name", "target_path", "target_qualified_name", "line", "metadata", "resolution_confidence"]
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def extractor_version() -> str:
    """Changes whenever an extractor does."""
    state = hashlib.sha256()
    for module in (extract_python, extract_sql, extract_ts, ts_syntax):
        state.update(inspect.getsource(module).encode())
    return state.hexdigest()[:16]


def generation_id(project: str, commit: str, digest: str, extractor: str) -> str:
    return hashlib.sha256("\0".join((project, commit, digest, extractor)).encode()).hexdigest()


def read_files(spark: SparkSession, root: Path | str, names: list[str]) -> DataFrame:
    """path, ordinal (the place in ``names``) and content (bytes) of files below ``root``, read by the executors."""
    schema = "path string, ordinal long, content binary"
    if not names:
        return spark.createDataFrame([], schema)
    escaped = [f"{root}/" + "".join("\\" + c if c in "\\*?[]{}," else c for c in n) for n in names]
    loaded = spark.read.format("binaryFile").load(escaped).select(F.col("path").alias("_uri"), "content")
    relative = F.substring("_uri", F.locate(f"{root}/", F.col("_uri")) + len(f"{root}/"), F.length("_uri"))
    listing = spark.createDataFrame(list(zip(names, range(len(names)))), "path string, ordinal long")
    return loaded.select(relative.alias("path"), "content").join(listing, "path").select("path", "ordinal", "content")


def decoded(content: Column) -> Column:
    """The text of valid UTF-8, else null."""
    return F.try_validate_utf8(content.cast("string"))


def extract_rows(files: DataFrame) -> DataFrame:
    """Every file's symbols and edges as rows of one shape; a file that can't be parsed gives a row ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ordinal, content in zip(batch["path"], batch["ordinal"], batch["content"]):
                base = {"path": path, "ordinal": ordinal}
                raw = bytes(content)
                if path.endswith(".py"):
                    try:
                        found = extract_python.extract(path, raw.decode("utf-8"))
                    except UnicodeDecodeError:
                        found = None
                    out.append(base | {"row": "module" if found else "error", "module": extract_python.module_name(path)})
                elif path.endswith(extract_ts.SUFFIXES):
                    try:
                        with extract_python.deep():
                            found = extract_ts.extract(path, raw.decode("utf-8", "replace"))
                    except RecursionError:  # a file too deep is an error of its own, not of the index
                        found = None
                        out.append(base | {"row": "error"})
                elif path.endswith(".sql"):
                    found = extract_sql.extract(path, raw.decode("utf-8", "ignore"))
                else:
                    continue
                symbols, edges = found or ([], [])
                out += [base | s | {"row": "symbol", "place": k} for k, s in enumerate(symbols)]
                for k, e in enumerate(edges):
                    specifier = e.get("specifier")
                    out.append(base | e | {"row": "edge", "place": k, "candidates": extract_ts.import_candidates(path, specifier) if specifier else None})
            frame = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
            yield frame.where(frame.notna(), None)

    return files.mapInPandas(run, ROWS)


def _linked_modules(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Python edges with _to, the path of the module they name: by its whole name, else (absolute names) by the first listed that ends with it."""
    exact = modules.groupBy("module").agg(F.max_by("path", "ordinal").alias("_path"), F.min("ordinal").alias("_first"))
    parts = F.split("module", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    ends = exact.where(F.size(parts) > 1).select("_path", "_first", F.explode(tails).alias("_end"))
    suffix = ends.groupBy("_end").agg(F.min_by("_path", "_first").alias("_by_end"))
    out = edges.join(exact.select("module", "_path"), "module", "left").join(suffix.withColumnRenamed("_end", "module"), "module", "left")
    return out.withColumn("_to", F.coalesce("_path", F.when(~F.col("relative"), F.col("_by_end")))).drop("_path", "_by_end")


def _linked_imports(edges: DataFrame, tracked: DataFrame) -> DataFrame:
    """Script edges with _to, the first candidate path that exists."""
    tried = edges.where(F.col("candidates").isNotNull()).select("path", "ordinal", "place", F.posexplode("candidates").alias("_k", "_candidate"))
    found = tried.join(tracked.select(F.col("path").alias("_candidate")), "_candidate").groupBy("path", "ordinal", "place").agg(F.min_by("_candidate", "_k").alias("_import"))
    return edges.join(found, ["path", "ordinal", "place"], "left").withColumn("_to", F.coalesce("_to", "_import")).drop("_import")


def linked_edges(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges with targets in other files looked up, and how sure they are."""
    edges = _linked_modules(rows.where("row = 'edge'"), rows.where("row = 'module'").select("module", "path", "ordinal"))
    script = F.lit(False)
    for suffix in extract_ts.SUFFIXES:
        script = script | F.col("path").endswith(suffix)
    edges = _linked_imports(edges, paths.where(script))
    there, local = F.col("_to").isNotNull(), F.col("missing").startswith("same_file_inheritance:")
    fallback = F.expr("substr(missing, length('same_file_inheritance:') + 1)")
    own = F.when(F.col("relation") == "overrides", F.concat(fallback, F.lit("."), "target_name")).otherwise(fallback)
    edges = edges.where(there | (F.col("missing") != ""))
    return edges.select(
        (F.shiftleft("ordinal", FILE_BITS) + F.col("place")).alias("id"),
        F.col("path").alias("source_path"),
        "source_name",
        "source_qualified_name",
        "relation",
        "target_name",
        F.when(there, F.col("_to")).when(local, F.col("path")).otherwise(F.col("target_path")).alias("target_path"),
        F.when(~there & local, own).otherwise(F.col("target_qualified_name")).alias("target_qualified_name"),
        "line",
        "metadata",
        F.when(there, F.col("found")).when(local, "same_file_inheritance").otherwise(F.col("missing")).alias("resolution_confidence"),
    )


def structure(spark: SparkSession, root: Path | str, names: list[str]) -> dict[str, DataFrame]:
    """files (path, authority, reason), symbols, edges and errors (path) of a checkout's files."""
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    files = paths.select("path", C.source_class(F.col("path")).alias("_c")).select("path", "_c.authority", "_c.reason")
    code = [n for n in names if n.endswith((".py", ".sql", *extract_ts.SUFFIXES))]
    rows = extract_rows(read_files(spark, root, code)).cache()
    symbols = rows.where("row = 'symbol'").select((F.shiftleft("ordinal", FILE_BITS) + F.col("place")).alias("id"), "path", "kind", "name", "qualified_name", "start_line", "end_line", "signature", "metadata")
    symbols = symbols.join(files.select("path", "authority"), "path")
    versioned = F.col("kind").isin(V.VERSIONED_KINDS) & (F.col("authority") == "schema_history")
    latest = L.mark_latest(symbols.where(versioned), F.lower("name"), ["path", "id"])
    symbols = latest.unionByName(symbols.where(~versioned).withColumn("active", F.lit(1))).select(*SYMBOL)
    # Calls of SQL functions lead to the only file that has an active function of the name.
    targets = L.unique_targets(symbols.where("kind = 'function' AND active = 1"), [F.lower("name"), F.lower("qualified_name"), F.lower(F.element_at(F.split("qualified_name", r"\."), -1))], "path", "qualified_name", "id")
    open_ = F.col("relation").isin(V.CALLABLE_RELATIONS) & F.col("target_path").isNull()
    edges = L.link_targets(linked_edges(rows, paths), targets, F.lower("target_name"), open_, "target_path", "target_qualified_name", "resolution_confidence", "active_sql").select(*EDGE)
    return {"files": files, "symbols": symbols, "edges": edges, "errors": rows.where("row = 'error'").select("path")}


def chunks(spark: SparkSession, root: Path | str, names: list[str], size: int = 80, overlap: int = 15) -> DataFrame:
    """path, start_line, end_line, content of the text files that are valid UTF-8."""
    texts = read_files(spark, root, names).select("path", decoded(F.col("content")).alias("text")).where("text IS NOT NULL")
    return X.chunk_lines(texts, "text", size, overlap)


def graph_digest(symbols: DataFrame, edges: DataFrame) -> str:
    """SHA-256 over all symbols and edges, whatever their order."""
    parts = (L.digests_by_key(symbols, "path", SYMBOL[1:]), L.digests_by_key(edges.withColumnRenamed("source_path", "path"), "path", [c for c in EDGE[1:] if c != "source_path"]))
    by_path = parts[0].withColumn("_part", F.lit(0)).unionByName(parts[1].withColumn("_part", F.lit(1))).orderBy("path", "_part")
    return hashlib.sha256(json.dumps([list(r) for r in by_path.toLocalIterator()]).encode()).hexdigest()


__all__ = ["chunks", "decoded", "extract_rows", "extractor_version", "generation_id", "git", "graph_digest", "linked_edges", "read_files", "structure"]
