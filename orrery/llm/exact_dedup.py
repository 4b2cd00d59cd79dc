"""Exact dedup: a tree merge of sorted digest runs.

Every row belongs to a run (a hash of its identifier). A run is sorted by digest and holds one entry for each: the
identifier that stays and the number of rows. In each binomial round ``fan_in`` runs hand one another the slices of
their digest range, so that runs become fewer while slices become more and every cell stays equally large. A cell
sorts the slices it got together (a multiway merge, which spills) and streams over the order: entries that follow one
another and agree in every digest become one, with the identifier that stays. After the last round one run is left, dealt
out over all slices. A digest with a third of all rows is one entry per run throughout.

The kept identifier travels in a struct, which Spark aggregates in sorted order only: the sorts are in the plan, and
tests/llm holds them there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded, cut, table, tidy, whole_row

ROWS_PER_RUN = 250_000
FAN_IN = 8
MIN_ROUNDS = 2


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha, size, check = [], [], []
        for text in batch.column(1):
            data = (text.as_py() or "").encode("utf-8", "replace").lower()  # bytes.lower() folds A-Z only
            sha.append(hashlib.sha256(data).digest())
            size.append(len(data))
            check.append(xxhash.xxh3_64_intdigest(data) - 2**63)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sha, pa.binary()), pa.array(size, pa.int64()), pa.array(check, pa.int64())], ["_id", "_sha", "_size", "_check"]
        )


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _sha (SHA-256 of the text, A-Z folded), _size (bytes) and _check (an unrelated hash). Null text counts as empty."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(_digests), "_id long, _sha binary, _size long, _check long")


def tree_merge(entries: DataFrame, keys: list[str], id_col: str = "_id", fan_in: int = FAN_IN, rows_per_run: int = ROWS_PER_RUN, keep: str = "max", rows: int | None = None) -> DataFrame:
    """``entries`` with _keep (the largest or smallest identifier with the same keys) and _group (the number of rows).

    Keys compare null-safe as long as they hold no nulls themselves; a null identifier is never kept while another
    is there. Rows that repeat an identifier count as often as they occur. An empty table gives an empty table.
    ``rows`` is how many rows there are, if that is known. All key columns are compared in every round, so that equal leading digests with unequal checks stay apart.
    """
    rounds = _rounds(entries, fan_in, rows_per_run, rows)
    leaf, level = _merged(entries, keys, id_col, fan_in, rounds, keep)
    # Answers go down the way the entries came up: a digest has one row per run, then one per row of that run.
    answers = leaf.select("_run", *keys).join(level.select(*keys, F.col("_keep._value").alias("_keep"), "_group"), keys)
    return _in_runs(entries, id_col, fan_in, rounds).join(answers, ["_run", *keys]).drop("_run")


def _rounds(entries: DataFrame, fan_in: int, rows_per_run: int, rows: int | None) -> int:
    rows, rounds = entries.count() if rows is None else rows, MIN_ROUNDS
    while fan_in**rounds * rows_per_run < rows:
        rounds += 1
    return rounds


def _in_runs(entries: DataFrame, id_col: str, fan_in: int, rounds: int) -> DataFrame:
    return entries.withColumn("_run", F.pmod(F.xxhash64(id_col), F.lit(fan_in**rounds)))


def _merged(entries: DataFrame, keys: list[str], id_col: str, fan_in: int, rounds: int, keep: str) -> tuple[DataFrame, DataFrame]:
    """The leaf runs (_run, keys, _keep, _group) and the run that is left; _keep is a struct whose _value is the identifier."""
    # Null identifiers come last whichever stays.
    best, known = {"max": (F.max, F.col(id_col).isNotNull()), "min": (F.min, F.col(id_col).isNull())}[keep]
    kept = F.struct(known.alias("_known"), F.col(id_col).alias("_value"))
    leaf = _in_runs(entries, id_col, fan_in, rounds).groupBy("_run", *keys).agg(best(kept).alias("_keep"), F.count(F.lit(1)).alias("_group"))
    level = leaf
    for k in range(1, rounds + 1):
        cells = level.withColumn("_run", F.expr(f"_run div {fan_in}")).withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(fan_in**k)))
        level = cells.repartition("_run", "_slice").groupBy("_run", "_slice", *keys).agg(best("_keep").alias("_keep"), F.sum("_group").alias("_group"))
    return leaf, level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. Of equal texts the row with the
    largest id stays. Rows that repeat an id are all returned and share its decision; a null id is kept only if its
    whole group has none. Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    merged = tree_merge(cut(text_digests(docs, id_col, text_col)), ["_sha", "_size", "_check"], **how)
    return merged.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_group").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns kept: that with the largest id, one of them if rows repeat it.

    Null text counts as empty; a row without an id stays only if its whole group has none. Columns may have any names. An
    empty table gives no rows. Texts are hashed once for the merge, of which digests alone are kept, and once as the rows
    that stay are looked up by digest and id, so that a hot text's rows go to as many tasks as they have ids.
    """
    keys = ["_sha", "_size", "_check"]
    entries = cut(text_digests(docs, id_col, text_col))
    _, level = _merged(entries, keys, "_id", FAN_IN, _rounds(entries, FAN_IN, ROWS_PER_RUN, None), "max")

    @F.pandas_udf("_sha binary, _size long, _check long")
    def digests(texts):
        import pandas as pd

        data = [x.encode("utf-8", "replace").lower() for x in texts]
        return pd.DataFrame({"_sha": [hashlib.sha256(x).digest() for x in data], "_size": [len(x) for x in data], "_check": [xxhash.xxh3_64_intdigest(x) - 2**63 for x in data]})

    winners = level.select(*(F.col(k).alias(f"_w{k}") for k in keys), F.col("_keep._value").alias("_w_id"))
    rows = bounded(docs).select(whole_row(docs.columns), F.col(id_col).cast("long").alias("_id"), digests(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_d")).select("_row", "_id", "_d.*")
    same = F.col("_id").eqNullSafe(F.col("_w_id"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_w{k}"))
    return rows.join(winners, same, "left_semi").dropDuplicates([*keys, "_id"]).select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256; null and empty texts are equal."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(folded) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY folded)
"""
