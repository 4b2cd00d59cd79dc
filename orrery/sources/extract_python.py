"""Symbols and edges of one Python file."""

from __future__ import annotations

import ast
import posixpath
import sys
from contextlib import contextmanager


def module_name(path: str) -> str:
    """The dotted name that the file has from the root of the checkout."""
    parts = posixpath.splitext(path)[0].split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def absolute_name(path: str, module: str | None, level: int) -> str:
    """The name that an import means; ``level`` dots count from the file's package."""
    package = module_name(path).split(".")[:-1]
    prefix = package[: max(0, len(package) - level + 1)] if level else []
    return ".".join([*prefix, *(module or "").split(".")]).strip(".")


#: How deeply a file's expressions and elements may be nested.
DEEPEST = 200_000


@contextmanager
def deep():
    """Lets Python functions call one another as deeply as a file is nested."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, DEEPEST))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class _Reader(ast.NodeVisitor):
    """Walks a tree twice: first for symbols, then, knowing them all, for edges."""

    def __init__(self, path: str):
        self.path, self.stack = path, []
        self.symbols: list[dict] = []
        self.edges: list[dict] = []
        self.by_name: dict[str, list[str]] = {}
        self.imports: dict[str, tuple[str, bool, str]] = {}  # alias: module, whether relative, qualified name
        self.collecting = True

    def _symbol(self, node: ast.AST, kind: str, name: str, signature: str) -> None:
        full = ".".join([*self.stack, name])
        self.symbols.append({"kind": kind, "name": name, "qualified_name": full, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "signature": signature[:500], "metadata": "{}"})
        self.by_name.setdefault(name, []).append(full)

    def _edge(self, node: ast.AST, relation: str, target: str, qualified: str, *, module: tuple[str, bool] | None = None, path: str | None = None, found: str = "unresolved", missing: str = "unresolved") -> None:
        if target:
            owner = (self.stack[-1], ".".join(self.stack)) if self.stack else ("<module>", self.path)
            self.edges.append(
                {"source_name": owner[0], "source_qualified_name": owner[1], "relation": relation, "target_name": target, "target_path": path, "target_qualified_name": qualified, "line": getattr(node, "lineno", 1), "metadata": "{}", "found": found, "missing": missing, "module": module[0] if module else None, "relative": bool(module and module[1])}
            )

    def _inside(self, node: ast.AST, name: str) -> None:
        self.stack.append(name)
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if self.collecting:
            self._symbol(node, "class", node.name, node.name)
        else:
            for base in node.bases:
                name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else ""
                if name in self.imports:
                    module, relative, full = self.imports[name]
                    self._edge(base, "extends", name, full, module=(module, relative), found="import_resolved")
                else:
                    self._edge(base, "extends", name, name)
        self._inside(node, node.name)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        if self.collecting:
            given = ", ".join(a.arg for a in node.args.args)
            self._symbol(node, "method" if self.stack else "function", node.name, f"{node.name}({given})")
        self._inside(node, node.name)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        if not self.collecting:
            for item in node.names:
                self.imports[item.asname or item.name.partition(".")[0]] = (item.name, False, item.name)
                self._edge(node, "imports", item.name, item.name, module=(item.name, False), found="exact_path", missing="external_or_unresolved")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if not self.collecting:
            module = (absolute_name(self.path, node.module, node.level), node.level > 0)
            for item in node.names:
                full = f"{node.module or ''}.{item.name}".strip(".")
                self.imports[item.asname or item.name] = (*module, full)
                self._edge(node, "imports", full, full, module=module, found="exact_path", missing="external_or_unresolved")

    def visit_Call(self, node: ast.Call) -> None:
        if not self.collecting:
            target = root = ""
            if isinstance(node.func, ast.Name):
                target = root = node.func.id
            elif isinstance(node.func, ast.Attribute):
                target, base = node.func.attr, node.func.value
                while isinstance(base, ast.Attribute):
                    base = base.value
                root = base.id if isinstance(base, ast.Name) else ""
            if root in self.imports:
                module, relative, full = self.imports[root]
                self._edge(node, "calls", target, full if root == target else f"{full}.{target}", module=(module, relative), found="import_resolved")
            elif len(own := self.by_name.get(target, [])) == 1:
                self._edge(node, "calls", target, own[0], path=self.path, missing="same_file")
            else:
                self._edge(node, "calls", target, target)
        self.generic_visit(node)


def extract(path: str, text: str) -> tuple[list[dict], list[dict]] | None:
    """(symbols, edges), or None if the file can't be parsed. Edges to other modules carry the module's name for a later join."""
    try:
        with deep():
            tree = ast.parse(text, filename=path)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    reader = _Reader(path)
    with deep():
        return _read(reader, tree, path, text)


def _read(reader: _Reader, tree: ast.Module, path: str, text: str) -> tuple[list[dict], list[dict]] | None:
    reader.symbols.append({"kind": "module", "name": posixpath.splitext(posixpath.basename(path))[0], "qualified_name": path, "start_line": 1, "end_line": max(1, len(text.splitlines())), "signature": path, "metadata": "{}"})
    reader.visit(tree)
    reader.collecting = False
    reader.visit(tree)
    return reader.symbols, reader.edges
