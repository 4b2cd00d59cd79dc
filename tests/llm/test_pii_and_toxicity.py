import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import pii as P
from orrery.llm import toxicity as T


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def brute(text):
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(P.PATTERNS[kind], text, re.A):
            digits, word = re.sub("[^0-9]", "", m[0]), m[0].replace(" ", "")
            near = (text[max(0, m.start() - P.CONTEXT_CHARS) : m.start()] + " " + text[m.end() : m.end() + P.CONTEXT_CHARS]).lower()
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
                "iban": kind == "iban" and 15 <= len(word) <= 34 and mod97(word),
                "ssn": bool(re.search(P.CONTEXT["ssn"], near)),
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b@c.d", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "+1 (555) 123-4567", "+1234", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "ssn 078-05-1120", "078-05-1120", "é日", "@", "..", "\n", " ", "word", "12", "+", "a@b.c@d.e", "...@a.b..c"]


def spans(row):
    return [(s["start"], s["kind"], s["stop"]) for s in row["pii"]]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["", " "]).join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14)))) for k in range(400)]
    found = {r["doc_id"]: spans(r) for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert found[k] == brute(text), text


def test_long_runs_and_edge_rows(spark):
    long = {1: "1" * 8_000, 2: "1 " * 30_000, 3: "a" * 6_000 + "@", 4: "1." * 30_000, 5: "+" + "(" * 30_000, 6: "A1" * 6_000, 7: None, 8: ""}
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in long.items()], "doc_id long, text string, pii string, n_email int")
    rows = P.find_pii(docs).collect()
    assert sorted(rows[0].asDict()) == ["doc_id", "n_email", "pii", "text"]
    assert {r["doc_id"]: spans(r) for r in rows} == {k: brute(t or "") for k, t in long.items()}
    digest = P.pii_digests(P.find_pii(docs.where("doc_id = 8"))).first()
    assert digest["base_sha256"] == hashlib.sha256(b"").hexdigest() and digest["spans"] == ""
    assert P.find_pii(docs.limit(0)).count() == 0


def test_digests_and_masks(spark):
    text = "é mail a.b@c.de, card 4111 1111 1111 1111 and iban GB82 WEST 1234 5698 7654 32."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in P.pii_digests(P.find_pii(docs)).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_card"], rows[1]["n_phone"]) == (1, 0, 1, 0)
    assert rows[1]["spans"] == "email:7:15,card:22:41,iban:51:78"
    assert rows[1]["base_sha256"] == hashlib.sha256(b"email:7:15,card:22:41").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in P.mask(P.find_pii(docs)).collect()}
    assert masked == {1: "é mail <EMAIL>, card <CARD> and iban <IBAN>.", 2: None, 3: "clean"}
    scores = {s["kind"]: s["score"] for s in P.find_pii(docs).where("doc_id = 1").first()["pii"]}
    assert scores[2] == pytest.approx(1.0) and scores[4] == pytest.approx(1.0)


def labelled(rng, n, group):
    """Texts of which those with a bad word are toxic; toxic ones also name the group more often."""
    rows = []
    for k in range(n):
        bad = rng.random() < 0.4
        words = [rng.choice(["red", "blue", "green", "walk", "talk", "tree", "stone"]) for _ in range(8)]
        if bad:
            words.append(rng.choice(["vile", "rotten", "scummy"]))
        if rng.random() < (0.6 if bad else 0.1):
            words.append(group)
        rng.shuffle(words)
        rows.append((k, " ".join(words) + ".", int(bad)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def parsed(rows):
    """Features as a matrix, labels and swaps of (id, text, label), by plain loops."""
    sets = [T.features(T.words(t)) for _, t, _ in rows]
    names = sorted({"rotten", "scummy", "vile", "old", "muslim", "women", "blue"} & set().union(*sets))
    x = np.array([[float(n in own) for n in names] for own in sets])
    changes = []
    for _, text, _ in rows:
        parts = [T.words(p) for p in text.replace("!", ".").split(".") if p]
        own = []
        for k, part in enumerate(parts):
            for term in part & T.others().keys():
                rest = T.features(set().union(*parts[:k], *parts[k + 1 :], part - {term}))
                own += [(T.features({term}) - rest, T.features({other}) - rest) for other in T.others()[term]]
        changes += [(a, b, 1 / len(own)) for a, b in own]
    return x, np.array([float(y) for *_, y in rows]), changes, names


def test_neutral_mentions_are_left_alone(spark):
    rows = labelled(random.Random(2), 400, "muslim")
    docs, labels = tables(spark, rows)
    model = T.train(docs, labels)
    assert model.score("a muslim walks by the tree") < 0.5 < model.score("a vile stone")
    assert abs(model.weights.get("muslim", 0)) < 0.5
    x, y, changes, names = parsed(rows)
    plain = T.fit(x, y, np.ones(len(y)), changes, names, swap_penalty=0.0)
    assert plain.weights["muslim"] > 2 * abs(model.weights.get("muslim", 0))
    got = T.toxicity(docs, labels).collect()
    hit = [r["predicted"] == rows[r["doc_id"]][2] for r in got if r["held_out"]]
    assert len(got) == 400 and sum(hit) / len(hit) > 0.95


def test_the_fit_equals_a_plain_optimiser():
    x, y, changes, names = parsed(labelled(random.Random(5), 120, "women"))
    got = T.fit(x.astype(np.uint8), y, np.ones(len(y)), changes, names)
    # Plain gradient descent on the loss as it is stated, every swap by itself.
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    d = np.array([[(n in gained) * 1.0 - (n in lost) for n in names] + [0.0] for lost, gained, _ in changes])
    weight = np.array([c[2] for c in changes])
    w = np.zeros(a.shape[1])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-a @ w))
        w -= 0.01 * (a.T @ (p - y) + T.RIDGE * np.append(w[:-1], 0) + T.SWAP_PENALTY * d.T @ (weight * (d @ w))) / 10
    assert np.allclose(w, [*(got.weights.get(n, 0.0) for n in names), got.bias], atol=0.02)


def test_rows_may_be_merged():
    x, y, changes, names = parsed(labelled(random.Random(6), 200, "old"))
    rows, counts = np.unique(np.concatenate([x, y[:, None]], axis=1), axis=0, return_counts=True)
    one, two = T.fit(x, y, np.ones(len(y)), changes, names), T.fit(rows[:, :-1], rows[:, -1], counts.astype(float), changes, names)
    assert one.bias == pytest.approx(two.bias, abs=1e-6) and all(one.weights[n] == pytest.approx(two.weights[n], abs=1e-6) for n in one.weights)


def test_swaps_equal_plain_sets_and_are_linear():
    rng = random.Random(7)
    pool = ["old", "older", "man", "woman", "white", "blanc", "frau", "tree", "manner", "womanly"]
    for _ in range(60):
        text = " ".join(rng.choice(pool) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 25)))
        *_, changes, _ = parsed([(0, text + " old vile.", 1)])
        want = {}
        for lost, gained, share in changes:
            want[frozenset(lost), frozenset(gained)] = want.get((frozenset(lost), frozenset(gained)), 0) + share
        got = T.swaps(text + " old vile.")
        assert {k: n / sum(got.values()) for k, n in got.items()} == pytest.approx(want)
    began = time.perf_counter()
    many = T.swaps("The old man and the white woman walk by. " * 25_000)
    assert len(many) < 1000 and time.perf_counter() - began < 10


def test_scores_of_a_batch_equal_those_of_each_text():
    rng = random.Random(8)
    model = T.Model(-1.5, {"vile": 2.0, "rott*": 1.0, "rotten": 0.25, "old": 0.5, "été": -1.0})
    texts = [None, "", "...", "ÉTÉ old", *(" ".join(rng.choice(["vile", "Rotten", "rotting", "old", "x1vile2", "été"]) for _ in range(rng.randrange(9))) for _ in range(50))]
    want = []
    for t in texts:
        own = set("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        z = -1.5 + sum(v for w, v in model.weights.items() if w in own or w.endswith("*") and any(len(x) > 4 and x.startswith(w[:-1]) for x in own))
        want.append(1 / (1 + math.exp(-z)))
    assert list(model.scores(pa.array(texts))) == pytest.approx(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_held_out_rows_of_the_tables(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in T.op2_toxicity(spark, at).collect() if r["held_out"] and r["doc_id"] in truth]
    wrong = [r for r in rows if not truth[r["doc_id"]] and r["predicted"]]
    found = [r for r in rows if truth[r["doc_id"]] and r["predicted"]]
    assert len(rows) > 50 and len(wrong) <= 0.02 * len(rows) and 2 * len(found) >= sum(truth[r["doc_id"]] for r in rows)


def test_held_out_labels_and_ids_play_no_part(spark):
    rows = labelled(random.Random(3), 200, "women")
    docs, labels = tables(spark, rows)
    held = {r["doc_id"] for r in docs.where(T.fold(docs["doc_id"]) == 0).collect()}
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    one, two = ({r["doc_id"]: r["score"] for r in T.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two
    import zlib

    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}


def test_edge_rows(spark):
    rows = labelled(random.Random(4), 60, "old")
    docs, labels = tables(spark, rows)
    odd = spark.createDataFrame([(None, "vile"), (900, None), (901, ""), (902, "vile " * 100_000), (902, "x")], "doc_id long, text string")
    got = T.toxicity(odd, labels.unionByName(spark.createDataFrame([(None, 1), (900, None)], "doc_id long, toxic int")), fit_on=docs).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert T.toxicity(docs.limit(0), labels).count() == 0
    lost = T.swaps("The old tree. A man walks, old man!")
    assert all(not gone or gone in ({"old"}, {"man"}) for gone, _ in lost) and (frozenset({"man"}), frozenset({"woman", "woma*"})) in lost
    assert len(T.toxicity(docs.withColumn("_score", F.lit("x")).withColumn("_row", F.lit(1)), labels).columns) == 4
    names = ["doc_id", "text", "_text", "_score", "_row", "_toxicity"]
    clashing = docs.selectExpr("doc_id", "text", "'a' AS _text", "'b' AS _score", "'c' AS _row", "'d' AS _toxicity")
    kept = T.clean(clashing, T.train(docs, labels)).collect()
    assert kept and all(list(r.asDict()) == names and tuple(r)[2:] == ("a", "b", "c", "d") for r in kept)


def test_only_near_copies_count_once(spark, monkeypatch):
    import xxhash

    least = sorted((f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"), key=xxhash.xxh3_64_hexdigest)
    first, others = least[: T.SKETCH], least[T.SKETCH :]
    # The same least hashes: texts of other words, of the same words, and with one word more.
    own = [first + others[10 * k : 10 * k + 10] for k in range(12)]
    texts = [x for words in own for x in (words, words[::-1], [*words, others[200]])]
    rows = [(k, " ".join(x), k // 3 % 2) for k, x in enumerate(texts)]
    rows += [(100 + k, " ".join(others[300 + k : 310 + k]), k % 2) for k in range(20)]
    seen, fit = [], T.fit
    monkeypatch.setattr(T, "fit", lambda x, labels, counts, *rest: seen.append(counts.sum()) or fit(x, labels, counts, *rest))
    monkeypatch.setattr(T, "fold", lambda column: T.F.lit(1))
    T.train(*tables(spark, rows))
    assert seen == [12 + 20]
