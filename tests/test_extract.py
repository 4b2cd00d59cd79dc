from orrery.sources import extract_python, extract_sql, extract_ts, git
from orrery.sources.ts_slice import Slice

from .conftest import SHOP

SCRIPT = """import React, {useMemo, type Foo as Bar} from 'react';
import * as rules from './rules';
import {check as verify} from '@/checks';
export function Panel({rows}: {rows: Row[]}) {
  const x = a < b ? rules.check(1) : `t ${rules.deep(a)} z`;
  return <Stat value={x} onClick={() => go(1)}>it's {rows.map(r => <li key={r.id}>{verify(r)}</li>)}</Stat>;
}
export default class Base { run(): void { this.stop(); } stop() {} }
export abstract class Board<T> extends Base implements X {
  private count = 0;
  constructor(private readonly api: Api) { super(); this.refresh(); }
  async refresh<T>(a?: string): Promise<Map<string, T>> { return this.api.functions.invoke('sync', {a}); }
  get total() { return this.count }
}
type Row = { id: string; f: (a: number) => void };
interface Props { a: string }
enum Color { Red, Green }
const useThing = function () { return db.from('things').select('*').eq('a', /x\\/(y)/.test(b)) };
const obj = { go: (x) => deep(x), stop() { halt() }, async wait(ms) { await sleep(ms) } };
Array.from(items).forEach(item => db.rpc('do_it', {item}));
db.from('orders')
  .insert({a: 1})
  .select();
"""


def test_script_symbols():
    symbols, _ = extract_ts.extract("src/p.tsx", SCRIPT)
    assert [(s["kind"], s["qualified_name"]) for s in symbols] == [
        ("module", "src/p.tsx"), ("function", "Panel"), ("class", "Base"), ("method", "Base.run"), ("method", "Base.stop"), ("class", "Board"), ("method", "Board.constructor"), ("method", "Board.refresh"),
        ("method", "Board.total"), ("type", "Row"), ("interface", "Props"), ("enum", "Color"), ("hook", "useThing"), ("method", "stop"), ("method", "wait"),
    ]


def test_script_edges():
    _, edges = extract_ts.extract("src/p.tsx", SCRIPT)
    seen = {(e["source_qualified_name"], e["relation"], e["target_name"], e["line"]): e for e in edges}
    assert seen["Panel", "calls", "check", 5]["specifier"] == "./rules"
    assert seen["Panel", "calls", "verify", 6]["target_qualified_name"] == "check"
    assert seen["Base.run", "calls", "stop", 8]["target_qualified_name"] == "Base.stop"
    assert seen["Board", "extends", "Base", 9]["missing"] == "same_file_inheritance"
    assert seen["Board.total", "overrides", "total", 13]["target_qualified_name"] == "Base.total"
    assert ("Board.refresh", "invokes_edge_function", "sync", 12) in seen
    assert ("useThing", "reads_table", "public.things", 18) in seen
    assert ("go", "calls", "deep", 19) in seen
    assert ("src/p.tsx", "writes_table", "public.orders", 21) in seen
    assert ("src/p.tsx", "calls_rpc", "public.do_it", 20) in seen
    assert not any(e["target_name"] == "from" for e in edges)


def test_odd_scripts_do_not_fail():
    for text in ("", "<", "`${", "class {", "const x = {", "import", "a => ", "function f(", "/*", "'", "<A b={", "x = y as", ")]}", "type X<"):
        extract_ts.extract("a.tsx", text)
        Slice("a.tsx", text)


def test_python_and_sql():
    symbols, edges = extract_python.extract("shop/service.py", SHOP["shop/service.py"])
    assert [(s["kind"], s["qualified_name"]) for s in symbols][1:] == [("class", "Base"), ("method", "Base.run"), ("class", "Special")]
    assert ("Base.run", "calls", "tidy_ticket") in {(e["source_qualified_name"], e["relation"], e["target_name"]) for e in edges}
    assert extract_python.extract("a.py", "def (") is None
    assert extract_python.absolute_name("a/b/c.py", "d", 2) == "a.d"
    symbols, edges = extract_sql.extract("m.sql", SHOP["migrations/001_tickets.sql"])
    assert [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in symbols] == [("function", "public.save_ticket", 3, 6), ("table", "public.tickets", 1, 1)]
    assert ("public.save_ticket", "accesses_table", "public.tickets", 5) in {(e["source_name"], e["relation"], e["target_name"], e["line"]) for e in edges}


def test_slices_reach_rendered_values():
    flows = Slice("src/board.tsx", SHOP["src/board.tsx"]).flows([{"line": 5, "target": "findConflicts", "relation": "calls"}])
    assert [n["label"] for n in flows[0]["chain"]][-1] == "Figure.value"
    assert flows[0]["sink_context"]["detail"] == "Conflicts / Gaps"
    tags = "const Tags = ({list}) => {\n  const shown = list.map((x) => ({key: x.key}));\n  return <Tag text={shown.key} />;\n};\n"
    assert [n["label"] for n in Slice("m.tsx", tags).flows([{"line": 2}])[0]["chain"]] == ["shown", "Tag.text"]


def test_hunks():
    diff = "+++ b/a.ts\n@@ -57 +57 @@\n@@ -71,2 +70,0 @@\n--- a/b.ts\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    assert git.new_ranges(diff) == [("a.ts", 57, 57), ("a.ts", 70, 70), ("a.ts", 0, 0)]
    assert git.old_ranges(diff) == [(57, 57), (71, 72), (1, 3)]

def test_deeply_nested_files_do_not_fail():
    chain = "x = a" + ".b" * 3000 + "()\n"
    total = "def f():\n    return " + " + ".join(f"g({k})" for k in range(5000)) + "\n"
    for text in (chain, total):
        found = extract_python.extract("deep.py", text)
        assert found is None or found[0]
    assert extract_python.extract("deep.py", total)[0][1]["name"] == "f"
    with extract_python.deep():
        symbols, _ = extract_ts.extract("deep.tsx", "function Deep() { return " + "<a>" * 3000 + "</a>" * 3000 + " }")
    assert [s["name"] for s in symbols if s["kind"] == "function"] == ["Deep"]
