"""A tool server: JSON-RPC messages, one a line, over standard input and output."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from .plans import maps
from .session import home, local_session
from .sources.store import Store

PROTOCOL = "2025-06-18"
NO_METHOD, NOT_JSON = -32601, -32700
_PROJECT = {"type": "string", "minLength": 1, "description": "The name of a registered checkout."}


def _tool(name: str, about: str, /, *, read_only: bool = True, required: tuple[str, ...] = (), **properties) -> dict:
    schema = {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": list(required)} if required else {})
    return {"name": name, "description": about, "inputSchema": schema} | ({"annotations": {"readOnlyHint": True}} if read_only else {})


def _whole(low: int, high: int, default: int) -> dict:
    return {"type": "integer", "minimum": low, "maximum": high, "default": default}


TOOLS = [
    _tool("repository_status", "Registered checkouts, and whether each index is that of the checkout as it is."),
    _tool(
        "map_code_context",
        "One compact map of the files, symbols, relations, shared resources, tests and SQL versions that a question is about. Evidence for navigation, no proof.",
        required=("project", "question"),
        project=_PROJECT,
        question={"type": "string", "minLength": 2},
        max_files=_whole(4, 30, 16),
        semantic_mode={"type": "string", "enum": ["auto", "fast", "code"], "default": "fast"},
    ),
    _tool("inspect_symbol", "A symbol's definitions, superseded ones included, and its direct relations.", required=("project", "name"), project=_PROJECT, name={"type": "string", "minLength": 1}, path={"type": "string", "minLength": 1}, limit=_whole(1, 50, 20)),
    _tool("audit_code_change", "Consumers, tests, resources and like-named symbols around the current changes that aren't among them: prompts for a review.", required=("project",), project=_PROJECT, base_ref={"type": "string", "default": "HEAD"}, question={"type": "string", "default": ""}, max_candidates=_whole(5, 60, 30)),
    _tool("refresh_repository", "Publishes a registered checkout's tables anew. Never writes to the checkout.", read_only=False, required=("project",), project=_PROJECT),
]


class Server:
    def __init__(self, store: Store):
        self.store = store

    def call(self, name: str, given: dict) -> object:
        if name == "repository_status":
            return self.store.statuses()
        project = given.get("project")
        if not isinstance(project, str):
            raise ValueError("project must be the name of a registered checkout")
        self.store.registry.root(project)
        if name == "map_code_context":
            return maps.map_context(self.store, project, given["question"], int(given.get("max_files", 16)), str(given.get("semantic_mode", "fast")))
        if name == "inspect_symbol":
            return maps.inspect_symbol(self.store, project, given["name"], given.get("path"), int(given.get("limit", 20)))
        if name == "audit_code_change":
            return maps.audit_change(self.store, project, str(given.get("base_ref", "HEAD")), str(given.get("question", "")), int(given.get("max_candidates", 30)))
        if name == "refresh_repository":
            return self.store.index(project, force=True)
        raise ValueError(f"unknown tool {name!r}")

    def answer(self, message: dict) -> dict | None:
        """The response, or None for a notification."""
        method, reply = message.get("method"), {"jsonrpc": "2.0", "id": message.get("id")}
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            asked = (message.get("params") or {}).get("protocolVersion", PROTOCOL)
            return reply | {"result": {"protocolVersion": asked, "capabilities": {"tools": {}}, "serverInfo": {"name": "orrery", "version": "0.1.0"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": TOOLS}}
        if method != "tools/call":
            return reply | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}
        params = message.get("params") or {}
        try:
            text, failed = json.dumps(self.call(params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False, indent=2), False
        except (KeyError, TypeError, ValueError, RuntimeError) as e:
            text, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": NOT_JSON, "message": str(e)}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()


if __name__ == "__main__":
    Server(Store(local_session(), home())).serve(sys.stdin, sys.stdout)
