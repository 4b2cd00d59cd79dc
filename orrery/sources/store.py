"""Published generations of a project's tables.

A generation is a folder of Parquet tables that never changes; a small manifest, replaced as a whole, names the current
one. Readers of an older generation keep what they read until the folder goes with the next publication but one.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embedded_text
from ..operators import relational as L
from . import git, ingest
from .registry import Registry

#: Models read so many characters of a chunk; a longer one says where it ends.
MOST_EMBEDDED = 16_000
CHUNK_KEY = ["path", "start_line", "end_line", "content"]


class StaleError(RuntimeError):
    """The checkout is newer than its index."""


class Store:
    def __init__(self, spark: SparkSession, home: Path | str):
        self.spark, self.home = spark, Path(home).resolve()
        self.registry = Registry(self.home / "projects.json")

    def _folder(self, project: str) -> Path:
        return self.home / "index" / project

    def manifest(self, project: str) -> dict | None:
        path = self._folder(project) / "manifest.json"
        return json.loads(path.read_text("utf-8")) if path.exists() else None

    def _publish(self, project: str, manifest: dict) -> None:
        path = self._folder(project) / "manifest.json"
        fresh = path.with_suffix(".new")
        fresh.write_text(json.dumps(manifest, indent=2, sort_keys=True), "utf-8")
        os.replace(fresh, path)

    def table(self, project: str, name: str) -> DataFrame:
        manifest = self.manifest(project)
        if manifest is None:
            raise StaleError(f"project {project!r} has no index; index it first")
        return self.spark.read.parquet(str(self._folder(project) / manifest["folder"] / name))

    def fingerprint(self, project: str) -> dict:
        root = self.registry.root(project)
        commit, digest, extractor = git.head(root), git.content_digest(root), ingest.extractor_version()
        return {"commit": commit, "content_digest": digest, "extractor_version": extractor, "generation_id": ingest.generation_id(project, commit, digest, extractor)}

    def index(self, project: str, force: bool = False) -> dict:
        """Publishes the checkout's tables, unless they are current. Raises StaleError, and publishes nothing, if the checkout changes meanwhile."""
        root, print_, before = self.registry.root(project), self.fingerprint(project), self.manifest(project)
        if before and not force and before["generation_id"] == print_["generation_id"]:
            return {"project": project, "current": True, **{k: v for k, v in before.items() if k != "folder"}}
        folder = self._folder(project)
        name = f"gen-{print_['generation_id'][:16]}-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
        out = folder / name
        try:
            listed = git.listed_files(root)
            tables = ingest.structure(self.spark, root, listed)
            for table in ("files", "symbols", "edges", "errors"):
                tables[table].write.parquet(str(out / table))
            self._write_chunks(project, out, ingest.chunks(self.spark, root, git.text_files(root)), print_, before is not None)
            read = lambda table: self.spark.read.parquet(str(out / table))
            symbols, edges = read("symbols"), read("edges")
            counts = edges.agg(F.count(F.lit(1)), F.count_if(F.col("resolution_confidence") == "unresolved")).first()
            manifest = print_ | {
                "project": project,
                "root": str(root),
                "folder": name,
                "files": len(listed),
                "symbols": symbols.count(),
                "edges": counts[0],
                "unresolved_edges": counts[1],
                "parse_errors": sorted(r[0] for r in read("errors").collect()),
                "graph_digest": ingest.graph_digest(symbols, edges),
                "indexed_at": datetime.now(timezone.utc).isoformat(),
            }
            if self.fingerprint(project) != print_:
                raise StaleError("the checkout changed while it was indexed; nothing was published")
            self._publish(project, manifest)
        except BaseException:
            shutil.rmtree(out, ignore_errors=True)
            raise
        for old in folder.glob("gen-*"):
            if old.name not in (name, before and before["folder"]):
                shutil.rmtree(old, ignore_errors=True)
        return {"project": project, "current": False, **{k: v for k, v in manifest.items() if k != "folder"}}

    def _write_chunks(self, project: str, out: Path, desired: DataFrame, print_: dict, again: bool) -> None:
        """Chunks that were there keep their ids; new ones get ids above all that were ever given."""
        if again:
            old = self.table(project, "chunks").select(*CHUNK_KEY, "chunk_id")
        else:
            old = self.spark.createDataFrame([], "path string, start_line int, end_line int, content string, chunk_id long")
        first = (old.agg(F.max("chunk_id")).first()[0] or 0) + 1
        found = L.publish_chunks(old, desired, CHUNK_KEY, "chunk_id").where("action <> 'delete'")
        fresh = F.lit(first) + F.monotonically_increasing_id()
        found.select(F.coalesce("chunk_id", fresh).alias("chunk_id"), *CHUNK_KEY, F.lit(print_["commit"]).alias("commit_hash"), F.lit(print_["generation_id"]).alias("generation_id")).write.parquet(str(out / "chunks"))

    # Vectors

    def _documents(self, project: str) -> DataFrame:
        """chunk_id, text and content_hash (of the text) of every chunk, as models read it."""
        text = embedded_text(project, F.col("path"), F.col("content"), MOST_EMBEDDED)
        return self.table(project, "chunks").select("chunk_id", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))

    def _cached(self, project: str, model: str) -> DataFrame:
        path = self._folder(project) / "vectors" / model
        if not path.exists():
            return self.spark.createDataFrame([], "content_hash string, model string, dimension int, vector array<float>")
        return self.spark.read.parquet(str(path)).dropDuplicates(["content_hash"])

    def vectors(self, project: str, model: str) -> DataFrame:
        """chunk_id, model, dimension, vector of the chunks whose text has a vector. Equal texts share one, wherever they move."""
        return self._documents(project).drop("text").join(self._cached(project, model), "content_hash").select("chunk_id", "model", "dimension", "vector")

    def embed(self, project: str, model: str, encode, batch: int = 32) -> dict:
        """Gives a vector to every text without one. ``encode`` makes a list of vectors of a list of texts, on the executors."""
        from ..operators.ranking import unit

        todo = self._documents(project).dropDuplicates(["content_hash"]).join(self._cached(project, model), "content_hash", "left_anti")

        def run(batches):
            import pandas as pd

            for frame in batches:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    made = encode(part["text"].tolist())
                    yield pd.DataFrame({"content_hash": part["content_hash"], "vector": [[float(x) for x in v] for v in made]})

        made = todo.select("content_hash", "text").mapInPandas(run, "content_hash string, vector array<double>")
        made.select("content_hash", F.lit(model).alias("model"), F.size("vector").alias("dimension"), unit(F.col("vector")).cast("array<float>").alias("vector")).write.mode("append").parquet(str(self._folder(project) / "vectors" / model))
        return self.coverage(project, model)

    def question_vector(self, model: str, question: str, encode) -> list[float]:
        """The question's vector, made once for each model."""
        name = hashlib.sha256(f"{model}\0{question}".encode()).hexdigest()
        path = self.home / "questions" / f"{name}.json"
        if path.exists():
            return json.loads(path.read_text("utf-8"))
        vector = [float(x) for x in encode([question])[0]]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(vector), "utf-8")
        return vector

    def coverage(self, project: str, model: str) -> dict:
        return L.coverage(self.table(project, "chunks"), self.vectors(project, model), "chunk_id", "chunk_id").first().asDict()

    # State

    def status(self, project: str) -> dict:
        root, print_, manifest = self.registry.root(project), self.fingerprint(project), self.manifest(project)
        current = bool(manifest) and all(manifest[k] == print_[k] for k in ("commit", "content_digest", "extractor_version"))
        return {
            "project": project,
            "root": str(root),
            "description": self.registry.note(project),
            "commit": print_["commit"],
            "generation_id": manifest["generation_id"] if manifest else None,
            "structural_current": current,
            "working_tree_dirty": git.is_dirty(root),
            "symbols": manifest["symbols"] if manifest else 0,
            "edges": manifest["edges"] if manifest else 0,
        }

    def statuses(self) -> dict:
        return {"home": str(self.home), "projects": [self.status(p) for p in self.registry.entries()]}

    def require_current(self, project: str) -> dict:
        """The project's status; raises StaleError unless the index is that of the checkout as it is."""
        status = self.status(project)
        if not status["structural_current"]:
            raise StaleError("the checkout is newer than its index; refresh it first")
        return status

    def unregister(self, project: str) -> dict:
        """Removes the project's tables and its entry; the checkout stays."""
        entry = self.registry.remove(project)
        shutil.rmtree(self._folder(project), ignore_errors=True)
        return entry | {"checkout_deleted": False}
