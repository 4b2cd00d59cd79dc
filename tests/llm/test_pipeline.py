import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

import corpus_pipeline  # noqa: E402
from orrery.llm import pii, toxicity  # noqa: E402

from .test_exact_and_warc import fold  # noqa: E402
from .test_ngram_and_lines import brute  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], DATA).write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r["doc_id"]: r for r in s.collect()} if k < 5 else s.collect() for k, s in enumerate(states)]
    assert all(s.columns == docs.columns for s in states[:5])
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(rows[1]) == {i for i, r in rows[0].items() if model.score(r["text"]) < 0.5}
    last = {}
    for i in sorted(rows[1]):
        last[fold(rows[1][i]["text"])] = i
    assert set(rows[2]) == set(last.values())
    near, _ = brute([(i, r["text"]) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, (_, c) in near.items() if i == c}
    assert set(rows[4]) == set(rows[3])
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(states[3]).collect()}
    for i, r in rows[4].items():
        assert (r["text"] == rows[3][i]["text"]) == (not found[i])
        assert r["n_chars"] == len(r["text"]) if found[i] else r == rows[3][i]
    assert {p["doc_id"] for p in rows[5]} == set(rows[4])
    assert sum(p["length"] for p in rows[5]) == sum({p["doc_id"]: p["doc_tokens"] for p in rows[5]}.values())


def test_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            if name == "exact_dedup" and rows:
                assert sorted(r["doc_id"] for r in docs.collect()) == [2, 3]
        assert (docs.count() > 0) == bool(rows)


def test_columns_of_any_name(spark):
    rows = [(k, f"words of number {k} and more of them here a.b{k}@c.de", "en", "s", 40, "a", 1, "b", "c", "d") for k in range(6)]
    names = ["_toxicity", "_row", "_pii", "_text", "__pii_email"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, _row int, _pii string, _text string, __pii_email string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns[5:] == names, name
    got = docs.collect()
    assert len(got) == 6 and all(tuple(r)[5:] == ("a", 1, "b", "c", "d") and "<EMAIL>" in r["text"] for r in got)
