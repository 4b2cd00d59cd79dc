"""Symbols and edges of one TypeScript or JavaScript file."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass

from .ts_syntax import Call, Class, Function, Source

# File suffixes, and the order in which an import is looked for.
SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
WRITES = re.compile(r"\.(insert|update|upsert|delete)\(")


def import_candidates(path: str, specifier: str) -> list[str]:
    """Paths that a relative or @/ import may mean, the likeliest first; none for packages."""
    if specifier.startswith("@/"):
        raw = posixpath.normpath("src/" + specifier[2:])
    elif specifier.startswith("."):
        raw = posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))
    else:
        return []
    return [raw, *(raw + s for s in SUFFIXES), *(f"{raw}/index{s}" for s in SUFFIXES)]


@dataclass
class Import:
    imported: str
    specifier: str
    namespace: bool = False


class Extraction:
    """Reads a file; edges whose target is another file carry the import's specifier for a later join."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.src = Source(text, jsx=path.endswith((".tsx", ".jsx", ".js")))
        self.imports: dict[str, Import] = {}
        self.symbols: list[dict] = []
        self.edges: list[dict] = []
        self._name_functions()
        self._symbols()
        self.wrappers = self._wrappers()
        self._edges()

    # Names

    def _name_functions(self) -> None:
        """What the places where functions stand call them: variables and properties."""
        src = self.src
        holders = {value: (at, end, name) for at, end, name, value in src.variables}
        self.variable_of: dict[int, tuple[int, int, str]] = {}
        for f in src.functions:
            holder = holders.get(f.start)
            if f.kind in ("arrow", "expression") and holder and src.end_of_value(f.start) <= max(f.end, holder[1]) and (holder[0] < 0 or holder[1] <= f.end):
                if f.kind == "expression" and f.own_name:
                    f.name = f.own_name
                else:
                    f.name = holder[2]
                if holder[0] >= 0:
                    self.variable_of[f.start] = holder
            elif f.kind == "expression" and f.own_name:
                f.name = f.own_name

    def _around(self, start: int, end: int) -> list[Function]:
        """Functions that hold the node, the innermost first."""
        return sorted((f for f in self.src.functions if f.start <= start and end <= f.end and (f.start, f.end) != (start, end)), key=lambda f: f.end - f.start)

    def _classes(self, start: int, end: int) -> list[Class]:
        return sorted((c for c in self.src.classes if c.name and c.start <= start and end <= c.end and (c.start, c.end) != (start, end)), key=lambda c: c.start)

    def qualified(self, start: int, end: int, name: str) -> str:
        parts = [c.name for c in self._classes(start, end)]
        for f in self._around(start, end):
            if f.name and f.name != name and f.name not in parts:
                parts.insert(0, f.name)
        return ".".join([*parts, name])

    def owner(self, start: int, end: int) -> tuple[str, str]:
        for f in self._around(start, end):
            if f.name:
                return f.name, self.qualified(f.start, f.end, f.name)
        return "<module>", self.path

    # Symbols

    def _add_symbol(self, kind: str, name: str, start: int, end: int) -> None:
        if name:
            signature = self.src.source(start, end).split("{", 1)[0][:500]
            self.symbols.append({"kind": kind, "name": name, "qualified_name": self.qualified(start, end, name), "start_line": self.src.start_line(start), "end_line": self.src.end_line(end), "signature": signature, "metadata": "{}", "at": start})

    def _symbols(self) -> None:
        for f in self.src.functions:
            holder = self.variable_of.get(f.start)
            if holder:
                name = holder[2]
                kind = "hook" if name.startswith("use") else "component" if name[:1].isupper() and name[:1].isascii() else "function"
                self._add_symbol(kind, name, holder[0], max(holder[1], f.end))
            elif f.kind == "declaration" or f.kind == "expression" and f.own_name and f.name == f.own_name:
                self._add_symbol("function", f.name, f.start, f.end)
            elif f.kind == "method":
                self._add_symbol("method", f.name, f.start, f.end)
        for c in self.src.classes:
            self._add_symbol("class", c.name, c.start, c.end)
        for n in self.src.named:
            self._add_symbol(n.kind, n.name, n.start, n.end)
        self.symbols.sort(key=lambda s: s["at"])
        self.by_name: dict[str, list[dict]] = {}
        for s in self.symbols:
            self.by_name.setdefault(s["name"], []).append(s)
        stem = posixpath.basename(self.path)
        module = {"kind": "module", "name": posixpath.splitext(stem)[0], "qualified_name": self.path, "start_line": 1, "end_line": self.text.count("\n") + 1, "signature": self.path, "metadata": "{}", "at": -1}
        self.symbols.insert(0, module)

    # Edges

    def _compact(self, start: int, end: int) -> str:
        return re.sub(r"\s+", "", self.src.source(start, end))[:240]

    def _literal(self, call: Call, index: int = 0) -> str:
        own = self.src.arguments(call)
        if index < len(own):
            start, end = own[index]
            if end == start + 1 and self.src.tokens[start].kind == "string":
                return self.src.tokens[start].value
        return ""

    def _plain_word(self, start: int, end: int) -> str:
        """The identifier that an argument is, through casts, parentheses and !."""
        src = self.src
        while end > start + 1:
            k = start
            while k < end and src.word(k) not in ("as", "satisfies"):
                k = src.tokens[k].pair + 1 if src.is_mark(k, "(", "[", "{") and src.tokens[k].pair > 0 else k + 1
            if start < k < end:
                end = k
            elif src.is_mark(start, "(") and src.tokens[start].pair == end - 1:
                start, end = start + 1, end - 1
            elif src.is_mark(end - 1, "!"):
                end -= 1
            elif src.skip_type_arguments(start) > start:
                start = src.skip_type_arguments(start)
            else:
                return ""
        return src.word(start) if end == start + 1 else ""

    def _wrappers(self) -> dict[str, tuple[str, int]]:
        """Functions that hand a parameter on as the name of a resource: name to its family and the parameter's place."""
        out: dict[str, tuple[str, int]] = {}
        for f in self.src.functions:
            if not f.name or f.body[0] >= f.body[1]:
                continue
            params = {name: k for k, name in enumerate(self._parameters(f)) if name}
            inner = [g for g in self.src.functions if f.body[0] <= g.start and g.end <= f.body[1] and g is not f]
            for call in self.src.calls:
                if not (f.body[0] <= call.start and call.close < f.body[1]) or any(g.start <= call.start and call.close < g.end for g in inner):
                    continue
                callee, own = self._compact(*call.callee), self.src.arguments(call)
                place = params.get(self._plain_word(*own[0])) if own else None
                if place is not None and callee.endswith((".rpc", ".from")):
                    out[f.name] = ("rpc" if callee.endswith(".rpc") else "table", place)
        return out

    def _parameters(self, f: Function) -> list[str]:
        start, end = f.params
        if not self.src.is_mark(start, "("):
            return [self.src.word(start)]
        fake = Call(start, (start, start), start, end)
        names = []
        for a, b in self.src.arguments(fake):
            while a < b and self.src.word(a) in ("public", "private", "protected", "readonly") and b > a + 1 and self.src.word(a + 1):
                a += 1
            names.append(self.src.word(a))
        return names

    def _outer(self, call: Call) -> str:
        """The text of the chain of calls and members that goes on from this call."""
        src, end = self.src, call.close + 1
        while True:
            if src.is_mark(end, ".", "?.") and src.word(end + 1):
                end += 2
            elif src.is_mark(end, "(", "[") and src.tokens[end].pair > 0 and not src._new_line(end):
                end = src.tokens[end].pair + 1
            else:
                return self._compact(call.start, end)

    def _add_edge(self, relation: str, target: str, start: int, end: int, *, path: str | None = None, specifier: str | None = None, qualified: str | None = None, found: str = "unresolved", missing: str = "unresolved", metadata: dict | None = None, owner: tuple[str, str] | None = None) -> None:
        """found and missing: the confidence if the specifier leads to a file, and if not."""
        if target:
            name, full = owner or self.owner(start, end)
            self.edges.append(
                {"source_name": name, "source_qualified_name": full, "relation": relation, "target_name": target, "target_path": path, "target_qualified_name": qualified, "line": self.src.start_line(start), "metadata": json.dumps(metadata or {}, ensure_ascii=False, separators=(",", ":")), "found": found, "missing": missing, "specifier": specifier, "at": start, "end": end}
            )

    def _target(self, call: Call) -> tuple[str, str]:
        """(root, name) of what is called."""
        src, (start, end) = self.src, call.callee
        if end == start + 1 and src.word(start):
            return src.word(start), src.word(start)
        if not (src.is_mark(end - 2, ".", "?.") and src.tokens[end - 1].kind == "word"):
            return "", ""
        name = src.tokens[end - 1].text
        if self._compact(start, end).startswith("newthis.constructor(") or self._compact(start, end - 2).strip("()").startswith("newthis.constructor"):
            return "this.constructor", name
        inner = range(start, end - 2)
        simple = all(src.tokens[k].kind == "word" if (k - start) % 2 == 0 else src.is_mark(k, ".", "?.") for k in inner)
        return (src.tokens[start].text if simple else ""), name

    def _edges(self) -> None:
        src = self.src
        events = [(k, "import", k) for k in range(len(src.tokens)) if src.word(k) == "import" and not src.is_mark(k + 1, "(", ".") and not src.is_mark(k - 1, ".") and src.at_statement(k)]
        events += [(c.start, "class", c) for c in src.classes if c.name] + [(c.start, "call", c) for c in src.calls]
        order = {"import": 0, "class": 1, "call": 2}
        for _, kind, node in sorted(events, key=lambda e: (e[0], order[e[1]], -(e[2].close if e[1] == "call" else 0))):
            if kind == "import":
                self._import(node)
            elif kind == "class":
                self._inheritance(node)
            else:
                self._call(node)

    def _import(self, k: int) -> None:
        src, at = self.src, k + 1
        at += src.word(at) == "type" and not src.is_mark(at + 1, ",") and src.word(at + 1) != "from"
        names: dict[str, Import] = {}
        if src.tokens[at].kind != "string" if at < len(src.tokens) else True:
            if src.word(at):
                names[src.word(at)] = Import("default", "")
                at += 1
            at += src.is_mark(at, ",")
            if src.is_mark(at, "*") and src.word(at + 1) == "as":
                names[src.word(at + 2)] = Import("*", "", True)
                at += 3
            elif src.is_mark(at, "{") and src.tokens[at].pair > 0:
                for a, b in src.arguments(Call(at, (at, at), at, src.tokens[at].pair)):
                    a += src.word(a) == "type" and b > a + 1 and src.word(a + 1) != "as"
                    names[src.tokens[b - 1].text] = Import(src.tokens[a].value or src.tokens[a].text, "")
                at = src.tokens[at].pair + 1
            if src.word(at) != "from":
                return
            at += 1
        if at < len(src.tokens) and src.tokens[at].kind == "string":
            specifier = src.tokens[at].value
            for name, own in names.items():
                own.specifier = specifier
                self.imports[name] = own
            self._add_edge("imports", specifier, k, at + 1, specifier=specifier, found="exact_path", missing="external_or_unresolved")

    def _inheritance(self, c: Class) -> None:
        if c.base is None:
            return
        start, end = c.base
        root, name = self._target(Call(start, (start, end), end, end))
        if not name:
            return
        full, imported = self.qualified(c.start, c.end, c.name), self.imports.get(root)
        own = {"found": "import_resolved_inheritance", "missing": ""}
        if imported and import_candidates(self.path, imported.specifier):
            qualified = name if imported.namespace or imported.imported == "default" else imported.imported
            place = {"specifier": imported.specifier}
        else:
            own, place = {}, {}
            qualified = ""
        local = next((s for s in self.by_name.get(name, []) if s["kind"] == "class"), None)
        if not place and local is None:
            return
        if not place:
            qualified, place, own = local["qualified_name"], {"path": self.path}, {"missing": "same_file_inheritance"}
        # An import that leads nowhere falls back to a class of this file, if there is one; else the edge goes (missing is empty).
        if own.get("missing") == "" and local is not None:
            own["missing"] = "same_file_inheritance:" + local["qualified_name"]
        self._add_edge("extends", name, c.start, c.end, qualified=qualified, metadata={"subclass": full}, owner=(c.name, full), **place, **own)
        for m in c.members:
            if m.name and m.name != "constructor":
                self._add_edge("overrides", m.name, m.start, m.end, qualified=f"{qualified}.{m.name}", metadata={"base_class": name, "subclass": full}, owner=(m.name, f"{full}.{m.name}"), **place, **own)

    def _call(self, call: Call) -> None:
        start, end = call.start, call.close + 1
        callee = self._compact(*call.callee)
        if callee.endswith((".rpc", ".from", ".functions.invoke")):
            name = self._literal(call)
            if callee.endswith(".rpc"):
                self._add_edge("calls_rpc", f"public.{name}" if name else "", start, end, qualified=f"public.{name}", missing="literal")
            elif callee.endswith(".from"):
                self._table(call, name, {}, "literal")
            else:
                self._add_edge("invokes_edge_function", name, start, end, qualified=name, missing="literal")
            return
        root, name = self._target(call)
        if not name or name in ("super", "import") and root == name:
            return
        root = "" if root == "super" else root
        if name in self.wrappers:
            family, place = self.wrappers[name]
            if literal := self._literal(call, place):
                if family == "rpc":
                    self._add_edge("calls_rpc", f"public.{literal}", start, end, qualified=f"public.{literal}", missing="literal_via_wrapper", metadata={"wrapper": name})
                else:
                    self._table(call, literal, {"wrapper": name}, "literal_via_wrapper")
        plain = call.callee[1] == call.callee[0] + 1
        meta = {"expression": callee, "receiver": root, "argument_count": len(self.src.arguments(call)), "optional_chain": call.optional, "call_kind": "identifier" if plain else "property"}
        imported = self.imports.get(root)
        if imported:
            qualified = name if imported.namespace or root != name else imported.imported
            self._add_edge("calls", name, start, end, specifier=imported.specifier, qualified=qualified, found="import_resolved", missing="external_import", metadata=meta)
            return
        local = self._local(name, start, end) if plain or root in ("this", "this.constructor") else None
        if local:
            self._add_edge("calls", name, start, end, path=self.path, qualified=local["qualified_name"], missing="same_file", metadata=meta)
        elif root in ("this", "this.constructor"):
            self._add_edge("calls", name, start, end, path=self.path, qualified=name, missing="same_class_unresolved", metadata=meta)
        else:
            self._add_edge("calls", name, start, end, qualified=name, metadata=meta)

    def _table(self, call: Call, name: str, metadata: dict, confidence: str) -> None:
        write = bool(WRITES.search(self._outer(call)))
        meta = metadata | {"operation": "write" if write else "read"}
        self._add_edge("writes_table" if write else "reads_table", f"public.{name}" if name else "", call.start, call.close + 1, qualified=f"public.{name}", missing=confidence, metadata=meta)

    def _local(self, name: str, start: int, end: int) -> dict | None:
        found = self.by_name.get(name, [])
        classes = [c.name for c in self._classes(start, end)]
        for s in found:
            if any(s["qualified_name"].startswith(f"{c}.") for c in classes):
                return s
        return found[0] if len(found) == 1 else None


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    own = Extraction(path, text)
    return own.symbols, own.edges
