import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import line_dedup as D
from orrery.llm import ngram_join as J


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}, links


def near_copies(rng, groups=10, size=12):
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.choice([5, 7, 9, 12, 15, 40, 150]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(["q", "r", "s"])
            if rng.random() < 0.3:
                own = own[: rng.randrange(max(1, len(own) - 3), len(own) + 1)]
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("long", [256, 2])
def test_equals_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "PART_GRAMS", 100 * long)
    rng = random.Random(long)
    texts = [*near_copies(rng), None, "", " \t\n", "one", "ONE", "one two", "É x y z w v", "é x y z w v", "a b c d e f"]
    rows = list(enumerate(texts)) + [(500 + k, "same words in all of these texts here") for k in range(5)]
    rng.shuffle(rows)
    want, links = brute(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _n int, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_components(docs).collect()}
    assert len(links) > 50 and got == want


@pytest.mark.parametrize("boundary", [12])
def test_subsets_find_the_links_of_small_sets(spark, monkeypatch, boundary):
    # Whatever the costs say: sets of up to twelve n-grams through their subsets, the others through lists.
    monkeypatch.setattr(J, "boundary_by_cost", lambda *_: boundary)
    rng = random.Random(12)
    rows = []
    for k in range(40):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randrange(8, 24))]
        for j in range(4):
            own = words[: len(words) - rng.randrange(2)] + ["end"] * rng.randrange(2)
            rows.append((4 * k + j, " ".join(own)))
    rows += [(1000, rows[0][1]), (1000, "another text with this id here"), (1001, "another text with this id here now")]
    unique = [r for r in rows if r[0] < 1000]
    want, links = brute(unique)
    small = [(a, b) for a, b in links if max(want[a][0], want[b][0]) <= boundary and unique[a][1] != unique[b][1]]
    assert small
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_components(spark.createDataFrame(unique, "doc_id long, text string")).collect()}
    assert got == want
    again = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(again) == len(rows) and {r["component_id"] for r in again if r["doc_id"] == 1000} == {want[0][1]}


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in J.ngram_components(docs).collect()))
    assert got == [(0, 0, 0), (0, 2, 0), (1, 2, 1), (2, 2, 1)]
    assert J.ngram_components(docs.limit(0)).count() == 0


def test_filters_lose_no_pair():
    for n in range(1, 200):
        low, high = J.partners(n)
        for m in range(low, min(high, n) + 1):
            need = J.shared(n, m)
            assert need >= m - (J.leading(m) - J.extra(m)) and J.leading(n) <= n
            common = min(J.extra(n), J.extra(m))  # of the leading n-grams
            assert J.leading(n) - common + 1 <= J.prefix(n) or J.leading(n) == n
        assert n >= 20 or set(J.subset_sizes(n)) == {c for m in range(low, high + 1) if (c := J.shared(n, m)) <= min(n, m)}


def test_overlaps_and_boundary():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(45)]
    got = J.overlaps(sets[:25], sets[25:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[25 + j])) for i in range(25) for j in range(20))
    assert J.boundary_by_cost({5: 100, 9: 100}, 50.0) >= 9 and J.boundary_by_cost({16: 1000}, 1.0) < 16


def test_long_texts_in_slices():
    long = " ".join(f"w{k}" for k in range(50_000))
    assert len(J.gram_sets(pa.array([long, None, "a"]))[0]) == 49_996


def test_repeated_rows_share_a_result(spark):
    rows = [(1, "first line of it\nsecond line of it"), (2, "first line of it\nsecond line of it\nx"), (2, "first line of it\nsecond line of it\nx"), (None, "first line of it\nsecond line of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in D.dedup_lines(docs).collect())
    assert got == [(0, rows[0][1]), (1, ""), (2, "x"), (2, "x")]
    assert D.dedup_lines(docs.limit(0)).count() == 0


def brute_runs(rows, least_lines, least_chars):
    """All lines of every run that any earlier place holds, too."""
    docs = {i: [x if x.strip(" ") else "" for x in (t or "").split("\n")] for i, t in rows}
    gone = {i: set() for i in docs}
    places = [(i, p) for i in sorted(docs) for p in range(len(docs[i]))]
    for i, p in places:
        for f, q in places:
            if (f, q) >= (i, p):
                break
            own, other, hi = docs[i], docs[f], p
            if p and q and own[p - 1] == other[q - 1]:
                continue  # not where a run begins
            while hi < len(own) and hi + q - p < len(other) and own[hi] == other[hi + q - p]:
                hi += 1
            run = own[p:hi]
            if any(run) and (len(run) >= least_lines or sum(map(len, run)) >= least_chars):
                gone[i].update(range(p, hi))
    return {i: sorted(g) for i, g in gone.items()}


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "", "a much longer line that counts for itself alone, by its characters"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    return [*rows, (60, "x\n\n\n\n\ny"), (61, "x\n\n \n\nz"), (62, "u\n\n\n\n\ny"), (97, "\n\n"), (98, ""), (99, None), (100, "line 1\n" * 30)]


@pytest.mark.parametrize("least_lines", [2, 3])
def test_every_run_of_lines_goes(spark, least_lines):
    rows = line_rows(least_lines)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed_lines"]) for r in D.dedup_lines(docs, least_lines=least_lines, least_chars=10**9).collect()}
    assert got == brute_runs(rows, least_lines, 10**9)


def test_lines_equal_brute_force(spark):
    rows = [*line_rows(4), (96, "line 1\n" * 300), (95, "\t\n\r\nline 3\r\n\t")]
    docs = spark.createDataFrame([(i, t, 7, "x", "y", "z") for i, t in rows], "doc_id long, text string, n_lines int, _key string, _row string, _gone string")
    clean = D.dedup_lines(docs)
    assert clean.columns == ["doc_id", "text", "_key", "_row", "_gone", "n_lines", "removed_lines"]
    got = {r["doc_id"]: (list(r["removed_lines"]), r["text"], r["n_lines"], r["_row"]) for r in clean.collect()}
    gone, texts = brute_runs(rows, D.LEAST_LINES, D.LEAST_CHARS), dict(rows)
    want = {i: (gone[i], None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len((t or "").split("\n")), "y") for i, t in texts.items()}
    assert got == want and any(g for g, *_ in got.values())


def test_the_third_document_repeats_the_second(spark):
    # x is the smaller hash, and its first place has another neighbour.
    x, *others = sorted((f"l{k}" for k in range(9)), key=lambda v: hashlib.md5(v.encode()).hexdigest())
    rows = [(1, f"{x}\n{others[0]}"), (2, f"{x}\n{others[1]}"), (3, f"{x}\n{others[1]}")]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [0, 1]}


def test_very_many_equal_lines_take_seconds(spark):
    rows = [(1, "the same\n" * 40_000), (2, "the same\n" * 20_000), (3, "other\n" + "\n" * 20_000)]
    began = time.perf_counter()
    got = {r["doc_id"]: (len(r["removed_lines"]), r["text"]) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (39_999, "the same\n") and got[2] == (20_001, "") and got[3][0] == 0
    assert time.perf_counter() - began < 60


def test_a_run_that_an_earlier_document_holds_in_part(spark):
    # The lines that windows select occur first alone; the first of the two documents with the run comes later.
    rng = random.Random(6)
    pairs = [(f"left {k}", f"right {k}") for k in range(20)]
    rows = [(k, f"{a}\nown {k}") for k, (a, _) in enumerate(pairs)] + [(100 + k, f"{b}\nown {100 + k}") for k, (_, b) in enumerate(pairs)]
    for start in (200, 300):
        rows += [(start + k, f"own {start + k}\n{a}\n{b}\nalso {start + k}") for k, (a, b) in enumerate(pairs)]
    rng.shuffle(rows)
    got = {r["doc_id"]: list(r["removed_lines"]) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [1, 2] if i >= 300 else [] for i, _ in rows}


@pytest.mark.parametrize("least_lines", [2, 3])
def test_every_long_line_goes(spark, least_lines):
    rng = random.Random(least_lines)
    # Long lines, whatever their hashes, between fresh lines.
    longs = [f"{k} " + " ".join(f"word{k * j}" for j in range(60)) for k in range(30)]
    fresh = [(1000 * j + k + 1000, f"fresh {j} {k}\n{x}\nmore {j} {k}") for j in range(3) for k, x in enumerate(longs)]
    rows = line_rows(least_lines) + fresh
    rng.shuffle(rows)
    got = {r["doc_id"]: list(r["removed_lines"]) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least_lines=least_lines).collect()}
    assert got == brute_runs(rows, least_lines, D.LEAST_CHARS)
    assert all(got[i] == ([1] if i >= 2000 else []) for i, _ in fresh)
