import json
import subprocess

import pytest

from orrery.plans import evaluate, reactive, simulate, twin
from orrery.sources.store import Store

from .conftest import commit, write


@pytest.fixture()
def store(spark, tmp_path, shop):
    store = Store(spark, tmp_path / "home")
    store.registry.add("shop", shop)
    store.index("shop")
    return store


def test_deleted_file_reaches_its_callers(store, shop, tmp_path):
    base = twin.capture(store, "shop")
    assert twin.capture(store, "shop").header["snapshot_digest"] == base.header["snapshot_digest"]
    twin.save(base, tmp_path / "t0")
    (shop / "shop/clean.py").unlink()
    write(shop, {"src/list.ts": (shop / "src/list.ts").read_text().replace("listTickets", "showTickets")})
    store.index("shop")
    delta = twin.compare(twin.load(store.spark, tmp_path / "t0"), twin.capture(store, "shop"))
    assert delta.changed_paths() == ["shop/clean.py", "src/list.ts"]
    changes = {(r["path"], r["qualified_name"], r["change"]) for r in delta.symbols.collect()}
    assert ("shop/clean.py", "tidy_ticket", "removed") in changes
    names = [(r["before_name"], r["after_name"], r["change"]) for r in delta.identities.collect()]
    assert names == [("listTickets", "showTickets", "rename_candidate")]
    both = twin.impact_of_delta(delta)
    assert "shop/service.py" in [c["path"] for c in both["candidates"]]
    assert both["algorithm"]["uses_removed_edges"]
    only = twin.impact_of_snapshot(delta.changed, ["shop/clean.py"])
    assert "shop/service.py" not in [c["path"] for c in only["candidates"]]
    assert "shop/service.py" in twin.render(delta, both)
    case = evaluate.score_case(delta, {"symbol_changes": [["shop/clean.py", "tidy_ticket", "removed"]], "impact_paths": ["shop/service.py"], "current_only_miss_paths": ["shop/service.py"]})
    assert evaluate.summarise([case]) == {"cases": 1, "delta_recall": 1.0, "union_recall": 1.0, "current_only_recall": 0.0, "planned_misses_confirmed": 1.0}


def test_tampered_snapshot(store, tmp_path):
    twin.save(twin.capture(store, "shop"), tmp_path / "t0")
    header = json.loads((tmp_path / "t0/header.json").read_text())
    (tmp_path / "t0/header.json").write_text(json.dumps(header | {"snapshot_digest": "0" * 64}))
    with pytest.raises(ValueError):
        twin.load(store.spark, tmp_path / "t0")


def test_impact_distribution(store):
    found = reactive.impact_distribution(store, "shop", ["src/api.ts"], limit=5)
    assert found["state"]["probability_mass"] == 1.0
    paths = [c["path"] for c in found["candidates"]]
    assert "tests/api.test.ts" in paths and "src/list.ts" in paths
    assert {c["path"]: c["temporal_activity"] for c in reactive.impact_distribution(store, "shop", ["src/api.ts"], 20)["candidates"]}["migrations/001_tickets.sql"] == 0.8
    assert reactive.distances(store, "shop", ["src/api.ts"])["tests/api.test.ts"] == 1
    with pytest.raises(ValueError):
        reactive.impact_distribution(store, "shop", [])


def test_obligations_for_a_diff(store, shop):
    write(shop, {"src/checks.ts": "export function findConflicts(rows) {\n  const slots = new Set();\n  return rows.filter((row) => slots.has(row.slot));\n}\n"})
    store.index("shop")
    found = reactive.field_for_diff(store, "shop", question="conflicts")
    (one,) = found["impact_field"]["obligations"]
    assert one["candidate_path"] == "src/board.tsx" and not one["proven_contradiction"]
    assert one["local_value_path"][-1]["label"] == "Figure.value"
    assert "OBLIGATION 1: src/board.tsx" in reactive.render(found)


def test_rankings_and_metrics(store):
    sample = {"id": "1", "project": "shop", "question": "saved tickets", "seed_paths": ["src/api.ts"], "gold_paths": ["src/list.ts", "tests/api.test.ts"]}
    rows = {r["method"]: r for r in evaluate.evaluate(store, [sample], ["lexical", "static", "map", "ppr_temporal", "hybrid"], 10).collect()}
    assert rows["static"]["recall"] == 1.0 and rows["ppr_temporal"]["recall"] == 1.0 and 0 < rows["hybrid"]["recall"] <= 1.0


def test_differential_schedule(spark, tmp_path):
    for name, text in (("t0", "print(1)\n"), ("t1", "raise SystemExit(1)\n")):
        write(tmp_path / name, {"a.py": text, "b.py": "print(2)\n"})
    scenarios = [{"id": "a", "path": "a.py", "command": ["python", "a.py"]}, {"id": "b", "path": "b.py", "command": ["python", "b.py"]}]
    found = simulate.outcomes(simulate.differential(spark, tmp_path / "t0", tmp_path / "t1", scenarios))
    assert {r["id"]: r["introduced_failure"] for r in found.collect()} == {"a": True, "b": False}
    compared = simulate.compare_schedulers(spark, found, 1, 40, {"candidates": []}, {"candidates": [{"path": "a.py", "score": 0.5}]})
    assert compared["twin_mesh"]["detection_rate"] == 1.0 and compared["general"] == compared["current_only"]
    with pytest.raises(ValueError):
        simulate.safe_path("../x")


def test_history_samples(shop):
    write(shop, {"src/api.ts": "export const a = 1;\n", "src/list.ts": "export const b = 1;\n", "tests/api.test.ts": "x();\n"})
    commit(shop)
    from orrery.sources import git

    (sample,) = git.history_samples(shop, 5)
    assert sample["anchor"] == "src/api.ts" and sample["gold"] == ["src/list.ts", "tests/api.test.ts"]
    assert subprocess.run(["git", "-C", str(shop), "status", "--porcelain"], capture_output=True, text=True, check=True).stdout == ""
