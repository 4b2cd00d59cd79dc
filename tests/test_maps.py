from types import SimpleNamespace

import pytest

from orrery.plans import maps
from orrery.plans.expand import Question
from orrery.sources.store import StaleError, Store

from .conftest import write


@pytest.fixture()
def store(spark, tmp_path, shop):
    store = Store(spark, tmp_path / "home")
    store.registry.add("shop", shop, "a fixture")
    store.index("shop")
    return store


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_index_links_and_marks(store):
    edges = rows(store.table("shop", "edges"))
    symbols = rows(store.table("shop", "symbols"))
    calls = {(e["source_path"], e["relation"], e["target_name"]): e for e in edges}
    assert calls["shop/service.py", "calls", "tidy_ticket"]["target_path"] == "shop/clean.py"
    assert calls["shop/service.py", "calls", "tidy_ticket"]["resolution_confidence"] == "import_resolved"
    assert calls["src/api.ts", "calls_rpc", "public.save_ticket"]["resolution_confidence"] == "active_sql"
    assert calls["src/api.ts", "calls_rpc", "public.save_ticket"]["target_path"] == "migrations/002_tickets.sql"
    assert calls["src/api.ts", "writes_table", "public.tickets"]["resolution_confidence"] == "literal_via_wrapper"
    assert calls["src/board.tsx", "imports", "./checks"]["target_path"] == "src/checks.ts"
    assert calls["src/board.tsx", "calls", "findConflicts"]["target_path"] == "src/checks.ts"
    active = {s["path"]: s["active"] for s in symbols if s["name"] == "public.save_ticket"}
    assert active == {"migrations/001_tickets.sql": 0, "migrations/002_tickets.sql": 1}
    status = store.status("shop")
    assert status["structural_current"] and not status["working_tree_dirty"] and status["symbols"] == len(symbols)
    assert store.index("shop")["current"]


def test_chunks_keep_their_ids(store, shop):
    before = {r["path"]: r["chunk_id"] for r in rows(store.table("shop", "chunks"))}
    write(shop, {"src/list.ts": "export const nothing = 1;\n"})
    store.index("shop")
    after = {r["path"]: r["chunk_id"] for r in rows(store.table("shop", "chunks"))}
    assert before.keys() == after.keys()
    assert [p for p in before if before[p] != after[p]] == ["src/list.ts"]


def test_map(store):
    found = maps.map_context(store, "shop", "How are tickets saved and listed?")
    paths = [f["path"] for f in found["map"]["files"]]
    assert {"src/api.ts", "src/list.ts"} <= set(paths)
    assert "save_ticket" in found["map"]["sql_lineage"]
    assert [v["active"] for v in found["map"]["sql_lineage"]["save_ticket"]] == [1, 0]
    assert found["retrieval"]["mode"] == "lexical+graph"


def test_lineage_of_many_functions(spark):
    called = [f"public.Made_{k}" for k in range(1500)]
    known = [(f"{v}.sql", "function", f"public.made_{k}" if k % 2 else f"MADE_{k}", f"public.made_{k}" if k % 2 else f"other.made_{k}", 1, 2, v) for k in range(1500) for v in (0, 1)]
    known += [("2.sql", "function", "made_3", "public.made_3", 1, 2, 1), ("3.sql", "function", None, None, 1, 2, 1), ("4.sql", "table", "made_3", "public.made_3", 1, 2, 1)]
    tables = {"symbols": spark.createDataFrame(known, "path string, kind string, name string, qualified_name string, start_line int, end_line int, active int")}
    found = SimpleNamespace(facts=spark.createDataFrame([("calls_rpc", t) for t in called], "relation string, target string"))
    got = maps._lineage(SimpleNamespace(table=lambda _, name: tables[name]), "p", found, Question(""))
    assert {n: [v["path"] for v in own] for n, own in got.items()} == {f"Made_{k}": ["2.sql"] * (k == 3) + ["1.sql", "0.sql"] for k in range(1500)}


def test_inspect(store):
    found = maps.inspect_symbol(store, "shop", "save_ticket")
    assert {d["active"] for d in found["definitions"]} == {0, 1}
    assert found["definitions"][0]["active"] == 1
    near = maps.inspect_symbol(store, "shop", "tidy_tiket")
    assert near["definitions"] == [] and near["suggestions"][0]["name"] == "tidy_ticket"


def test_audit_reaches_consumers_and_tests(store, shop):
    text = (shop / "src/api.ts").read_text()
    write(shop, {"src/api.ts": text.replace("upsert(ticket)", "upsert({...ticket})")})
    with pytest.raises(StaleError):
        maps.audit_change(store, "shop")
    store.index("shop")
    found = maps.audit_change(store, "shop", question="tickets")
    ripple = {c["path"] for c in found["review_map"]["ripple_candidates_not_in_diff"]}
    assert found["diff"]["changed_files"] == ["src/api.ts"]
    assert "src/list.ts" in ripple
    assert any(s["name"] == "saveTicket" for s in found["diff"]["changed_symbols"])
    assert "tests/api.test.ts" in {c["path"] for c in found["review_map"]["related_tests_not_in_diff"]}
    assert not found["review_map"]["test_gap_candidate"]


def test_hybrid_retrieval(store):
    def encode(texts):
        return [[1.0, float("ticket" in t.lower()), float("conflict" in t.lower())] for t in texts]

    assert store.embed("shop", "toy", encode)["semantic_coverage"] == 1.0
    hits, used, failed = maps.retrieve(store, "shop", "conflict", 5, "auto", model="toy", encode=encode)
    assert used == "hybrid" and failed is None and "conflict" in hits[0].content.lower()
    asked = []
    assert store.question_vector("toy", "conflict", lambda texts: asked.append(texts)) == [1.0, 0.0, 1.0] and not asked
    # A file that moves keeps no chunk, but texts are known by their content.
    texts = {r["text"] for r in store._documents("shop").collect()}
    assert all(t.startswith("Project: shop\nFile: ") for t in texts)
    assert store._cached("shop", "toy").count() == len(texts) and store.embed("shop", "toy", None)["semantic_coverage"] == 1.0
    with pytest.raises(RuntimeError):
        maps.retrieve(store, "shop", "conflict", 5, "code")


def test_unregister_keeps_the_checkout(store, shop):
    assert store.unregister("shop") == {"project": "shop", "path": str(shop), "description": "a fixture", "checkout_deleted": False}
    assert (shop / "README.md").exists() and store.manifest("shop") is None
