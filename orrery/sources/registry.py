"""The checkouts that may be read, in a small JSON file that every access reads anew."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .git import git

# What a project may be called, and the file's version.
NAME = re.compile("[a-z][a-z0-9_-]{0,63}")
VERSION = 1


class Registry:
    def __init__(self, path: Path | str):
        self.path = Path(path)

    def entries(self) -> dict[str, dict[str, str]]:
        """name: {path, description}, in the file's order. Raises RuntimeError if the file isn't a registry."""
        if not self.path.exists():
            return {}
        try:
            data = json.loads(self.path.read_text("utf-8"))
            projects = data["projects"].items() if data["version"] == VERSION else None
        except (ValueError, TypeError, KeyError, AttributeError):
            projects = None
        if projects is None:
            raise RuntimeError(f"not a project registry: {self.path}")
        out = {}
        for name, entry in projects:
            if not NAME.fullmatch(name) or not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or not os.path.isabs(entry["path"]):
                raise RuntimeError(f"bad entry {name!r} in {self.path}")
            out[name] = {"path": str(Path(entry["path"]).resolve()), "description": str(entry.get("description") or "")}
        return out

    def _save(self, projects: dict) -> None:
        """Replaces the file as a whole, after its bytes have reached the disk."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent, prefix=f".{self.path.name}.")
        try:
            with open(handle, "w", encoding="utf-8") as file:
                file.write(json.dumps({"version": VERSION, "projects": dict(sorted(projects.items()))}, ensure_ascii=False, indent=2) + "\n")
                file.flush()
                os.fsync(file.fileno())
            os.replace(name, self.path)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise

    def root(self, name: str) -> Path:
        entries = self.entries()
        if name not in entries:
            raise ValueError(f"unknown project {name!r}; there are: {', '.join(entries) or 'none'}")
        return Path(entries[name]["path"])

    def note(self, name: str) -> str:
        root = self.root(name)
        return self.entries()[name]["description"] or f"Registered checkout at {root}"

    def add(self, name: str, root: Path | str, description: str = "") -> dict:
        if not NAME.fullmatch(name):
            raise ValueError("a project's name has up to 64 lower-case letters, digits, - and _, a letter first")
        path = Path(root).expanduser().resolve()
        if not path.is_dir():
            raise ValueError(f"no such folder: {path}")
        try:
            top = Path(git(path, "rev-parse", "--show-toplevel")).resolve()
        except RuntimeError:
            raise ValueError(f"not a Git checkout: {path}") from None
        if top != path:
            raise ValueError(f"register the checkout's root {top}, not {path}")
        entries = self.entries()
        if name in entries:
            raise ValueError(f"project {name!r} is registered already")
        if any(e["path"] == str(path) for e in entries.values()):
            raise ValueError(f"checkout {path} is registered already")
        entry = {"path": str(path), "description": description.strip()}
        self._save(entries | {name: entry})
        return {"project": name, **entry}

    def remove(self, name: str) -> dict:
        entries = self.entries()
        if name not in entries:
            raise ValueError(f"unknown project {name!r}")
        entry = entries.pop(name)
        self._save(entries)
        return {"project": name, **entry}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, e["path"], e["description"]) for n, e in self.entries().items()], "name string, path string, description string")
