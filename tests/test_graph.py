import heapq
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import ranking as R
from orrery.operators import relational as L
from orrery.operators import schedule as S

EDGES = "id long, source_path string, source_name string, source_qualified_name string, relation string, target_name string, target_path string, target_qualified_name string, line int, resolution_confidence string"


def random_steps(spark, seed, nodes=14, edges=40):
    rng = random.Random(seed)
    rows = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}"): round(rng.uniform(0.3, 1.0), 3) for _ in range(edges)}
    rows = {k: w for k, w in rows.items() if k[0] != k[1]}
    return rows, spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "source string, target string, weight double")


@pytest.mark.parametrize("seed,hops", [(1, 2), (2, 3), (3, 4)])
def test_max_product_is_best_first(spark, seed, hops):
    rows, steps = random_steps(spark, seed)
    best, heap = {"n0": 1.0}, [(-1.0, 0, "n0")]
    while heap:
        s, h, node = heapq.heappop(heap)
        if -s + 1e-15 < best[node] or h >= hops:
            continue
        for (a, b), w in rows.items():
            if a == node and -s * 0.78 * w > best.get(b, 0) + 1e-15:
                best[b] = -s * 0.78 * w
                heapq.heappush(heap, (-best[b], h + 1, b))
    got = {r["node"]: r["score"] for r in G.max_product(steps, spark.createDataFrame([("n0",)], "path string"), hops).collect()}
    assert got.keys() == best.keys()
    assert all(abs(got[k] - best[k]) < 1e-12 for k in best)


def test_page_rank_loop_is_the_kernel(spark):
    _, steps = random_steps(spark, 5)
    probabilities = G.normalised(steps.withColumn("direction", F.lit("toward_dependent")).withColumn("lines", F.array(F.lit(1))))
    seeds = spark.createDataFrame([("n0",), ("n1",)], "path string")
    one = {r["node"]: r["mass"] for r in G.page_rank_kernel(probabilities, seeds).collect()}
    two = {r["node"]: r["mass"] for r in G.page_rank(probabilities, seeds, tolerance=1e-6, every=12).collect()}
    assert abs(sum(one.values()) - 1) < 1e-9
    assert all(abs(one.get(k, 0) - two.get(k, 0)) < 1e-5 for k in {*one, *two})


def test_strict_steps_of_changed_lines_only(spark):
    steps = spark.createDataFrame([("a", "b", "calls", "toward_dependency", "b", "a", 1.0, [3]), ("a", "c", "calls", "toward_dependency", "c", "a", 1.0, [9]), ("a", "d", "calls", "toward_dependent", "a", "d", 1.0, [1])], "source string, target string, relation string, direction string, evidence_target string, evidence_path string, weight double, lines array<int>")
    seeds, ranges = spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a", 2, 4)], "path string, range_start int, range_end int")
    share = lambda strict: {r["target"]: round(r["probability"], 6) for r in G.normalised(steps, seeds, ranges, strict=strict).collect()}
    assert share(True) == {"b": round(2.5 / 3.5, 6), "c": 0.0, "d": round(1 / 3.5, 6)}
    assert share(False)["c"] == round(0.2 / 3.7, 6)


def test_strongest_path(spark):
    rows = [("s", "a", 0.9), ("a", "t", 0.9), ("s", "t", 0.5), ("t", "s", 1.0)]
    steps = spark.createDataFrame(rows, "source string, target string, probability double")
    found = G.strongest_paths(steps, spark.createDataFrame([("s",)], "path string"), spark.createDataFrame([("t",)], "path string")).first()
    assert found["path"] == ["s", "a", "t"]


def test_temporal_activity(spark):
    symbols = spark.createDataFrame([("m1", "function", 0), ("m1", "table", 1), ("m2", "function", 0), ("m2", "view", 1), ("c", "function", 0)], "path string, kind string, active int")
    authority = spark.createDataFrame([("m1", "schema_history"), ("m2", "schema_history"), ("m3", "schema_history"), ("c", "code")], "path string, authority string")
    assert {r["path"]: r["activity"] for r in G.temporal_activity(symbols, authority).collect()} == {"m1": 0.8, "m2": 0.5, "m3": 0.8, "c": 1.0}


def test_fusion():
    assert R.fuse_lists([["a", "b"], ["b", "c"]], [1.0, 0.5]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        R.fuse_lists([["a"]], [1.0, 2.0])


def test_schedule_by_chance_and_by_impact(spark):
    rows = spark.createDataFrame([("bad", "p", True), ("a", "q", False), ("b", "q", False)], "id string, path string, introduced_failure boolean")
    scores = spark.createDataFrame([("p", 1.0)], "path string, score double")
    assert S.replay(S.schedules(spark, rows, 50, 1, scores), rows, 1).first()["detection_rate"] == 1.0
    assert 0 < S.replay(S.schedules(spark, rows, 50, 1), rows, 1).first()["detection_rate"] < 1.0
    with pytest.raises(ValueError):
        S.schedules(spark, rows, 50, 4)


def test_multiset_publish(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, id long")
    new = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    rows = sorted((r["k"], r["id"] or 0, r["action"]) for r in L.publish_chunks(old, new, ["k"], "id").collect())
    assert rows == [("a", 1, "delete"), ("a", 2, "keep"), ("b", 3, "delete"), ("c", 0, "insert"), ("c", 0, "insert")]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "source string, target string, weight double")
    assert G.max_product(none, spark.createDataFrame([("a",)], "path string")).count() == 1
    docs = spark.createDataFrame([], "id long, text string")
    assert R.bm25(docs, ["x"], {"text": 1.0}).count() == 0
    assert R.bm25(spark.createDataFrame([(1, None)], "id long, text string"), ["x"], {"text": 1.0}).count() == 0


def test_bm25_ranks_phrases(spark):
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "bar foo"), (3, "Fóo Bar foo bar"), (4, "nothing here")], "id long, text string")
    found = [r["id"] for r in R.bm25(docs, ["foo.bar"], {"text": 1.0}).orderBy(F.desc("score")).collect()]
    assert found == [3, 1]


def test_same_name_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.choice(["run", "Run", "stop", None]), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(400)]
    symbols = spark.createDataFrame(rows, "id long, name string, path string")
    got = {}
    for r in L.same_name(symbols, symbols, "name", "path", ["path", "id"]).collect():
        got.setdefault(r["id"], []).append(r["existing_id"])
    want = {}
    for k, name, path in rows:
        if name and path:
            want[k] = [i for p, i in sorted((p, i) for i, n, p in rows if n and p and n.lower() == name.lower() and p != path)][:12]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    plan = spark.range(2000).selectExpr("id", "'same' AS name", "CAST(id % 50 AS STRING) AS path")
    found = L.same_name(plan, plan, "name", "path", ["path", "id"])
    assert found.count() == 2000 * 12
    # What the join makes, before the last ranking.
    made, join = [], type(plan).join
    monkeypatch.setattr(type(plan), "join", lambda *a: made.append(join(*a)) or made[-1])
    L.same_name(plan, plan, "name", "path", ["path", "id"])
    assert max(df.count() for df in made) <= 2000 * 24
