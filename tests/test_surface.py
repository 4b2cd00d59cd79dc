import io
import json

import pytest

from orrery import cli
from orrery.server import TOOLS, Server
from orrery.sources.registry import Registry
from orrery.sources.store import Store
from orrery.streaming import refresh


def test_registry(tmp_path, shop):
    registry = Registry(tmp_path / "projects.json")
    assert registry.entries() == {}
    registry.add("shop", shop, " notes ")
    assert registry.note("shop") == "notes"
    for name, path in (("Shop", shop), ("shop", tmp_path), ("other", shop), ("other", shop / "src"), ("other", tmp_path / "none")):
        with pytest.raises(ValueError):
            registry.add(name, path)
    (tmp_path / "projects.json").write_text("[]")
    with pytest.raises(RuntimeError):
        registry.entries()


def test_server(spark, tmp_path, shop):
    store = Store(spark, tmp_path / "home")
    store.registry.add("shop", shop)
    messages = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "inspect_symbol", "arguments": {"project": "shop", "name": "x"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "refresh_repository", "arguments": {"project": "shop"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "inspect_symbol", "arguments": {"project": "shop", "name": "tidy_ticket"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "nothing"},
    ]
    out = io.StringIO()
    Server(store).serve(io.StringIO("\n".join(map(json.dumps, messages)) + "\nnot json\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None]
    assert [t["name"] for t in replies[1]["result"]["tools"]] == [t["name"] for t in TOOLS]
    assert replies[2]["result"]["isError"] and not replies[3]["result"]["isError"]
    assert json.loads(replies[4]["result"]["content"][0]["text"])["definitions"][0]["path"] == "shop/clean.py"
    assert replies[5]["error"]["code"] == -32601 and replies[6]["error"]["code"] == -32700


def test_command_line(spark, tmp_path, shop, capsys):
    run = lambda *args: (cli.main(["--home", str(tmp_path / "home"), *args]), json.loads(capsys.readouterr().out))[1]
    assert run("project", "add", "shop", str(shop))["project"] == "shop"
    assert run("project", "list")[0]["path"] == str(shop)
    assert run("index", "shop")["files"] == 10
    assert run("status")["projects"][0]["structural_current"]
    assert run("project", "remove", "shop")["checkout_deleted"] is False


def test_streamed_chunks(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    put = lambda rows: spark.createDataFrame(rows, refresh.SCHEMA).write.mode("append").json(str(source))

    def run():
        stream = spark.readStream.schema(refresh.SCHEMA).json(str(source))
        refresh.refresh_chunks(stream, table, str(tmp_path / "state"), 2, 0).awaitTermination()
        return sorted((r["path"], r["start_line"], r["content"]) for r in refresh.current_chunks(spark, table).collect())

    put([("a", "1\n2\n3", 1), ("b", "x", 1)])
    assert run() == [("a", 1, "1\n2"), ("a", 3, "3"), ("b", 1, "x")]
    put([("a", "9", 3), ("a", "8", 2), ("b", None, 2)])
    assert run() == [("a", 1, "9")]
