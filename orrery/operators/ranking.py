"""Ranked retrieval: BM25, specificity, vectors, fusion, quality metrics."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def phrase_hits(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens follow one another in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x == phrase[0]))

    def here(k: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.get(tokens, k + i) == w for i, w in enumerate(phrase)))

    starts = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(0), F.size(tokens) - len(phrase))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, here))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns, computed once: later projections can't repeat what a generator has made."""
    made = rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.select(*rows.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


def bm25(docs: DataFrame, terms: list[str], fields: dict[str, float], keep: Column | None = None, score_col: str = "score") -> DataFrame:
    """``docs`` that hit a term, with their score: higher is better.

    A term is a phrase of search tokens; ``fields`` names text columns and what a hit in each weighs. How many documents
    there are, how many hit a term and how long they are on average is taken over all of ``docs``; ``keep`` then
    chooses which documents to return. One pass counts, one scores; the statistics are a single row.
    """
    phrases = [p for p in map(X.phrase_tokens, terms) if p]
    if not phrases:
        return docs.limit(0).withColumn(score_col, F.lit(0.0))
    single = sorted({p[0] for p in phrases if len(p) == 1})
    tokens = {f"_t{k}": X.search_tokens(F.coalesce(F.col(field).cast("string"), F.lit(""))) for k, field in enumerate(fields)}
    counted = once(docs, tokens)
    few = {f"_s{k}": F.filter(f"_t{k}", lambda x: x.isin(single)) for k in range(len(fields))} if single else {}
    length = reduce(lambda a, b: a + b, (F.size(t) for t in tokens))
    counted = once(counted, {"_length": length, **few})

    def hits(p: list[str]) -> Column:
        own = "_s" if len(p) == 1 else "_t"
        return reduce(lambda a, b: a + b, (F.lit(float(w)) * phrase_hits(F.col(f"{own}{k}"), p) for k, w in enumerate(fields.values())))

    counted = once(counted, {f"_f{i}": hits(p) for i, p in enumerate(phrases)}).drop(*tokens, *few)
    stats = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(phrases))))
    both = counted.where(reduce(lambda a, b: a | b, (F.col(f"_f{i}") > 0 for i in range(len(phrases)))))
    if keep is not None:
        both = both.where(keep)
    both = both.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}")
        idf = F.log((F.col("_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(V.LEAST_IDF)
        return idf * f * (V.BM25_K1 + 1) / (f + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("_length") / F.col("_mean")))

    return both.select(*docs.columns, reduce(lambda a, b: a + b, map(part, range(len(phrases)))).alias(score_col))


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    return ranked.orderBy(*order).limit(k)


def term_frequencies(docs: DataFrame, terms: list[str], unit: str, fields: list[str]) -> DataFrame:
    """One row: _units, how many units (paths) there are, and _d0, _d1, ..., how many hit each term in any field."""
    hit = []
    for term in terms:
        phrase = X.phrase_tokens(term)
        found = [phrase_hits(F.col(f"_t{k}"), phrase) > 0 for k in range(len(fields))] if phrase else [F.lit(False)]
        hit.append(reduce(lambda a, b: a | b, found))
    own = once(docs.select(unit, *fields), {f"_t{k}": X.search_tokens(F.coalesce(F.col(f), F.lit(""))) for k, f in enumerate(fields)})
    by_unit = own.groupBy(unit).agg(*(F.max(h).alias(f"_h{i}") for i, h in enumerate(hit)))
    return by_unit.agg(F.count(F.lit(1)).alias("_units"), *(F.count_if(F.col(f"_h{i}")).alias(f"_d{i}") for i in range(len(terms))))


def specificity(ranked: DataFrame, frequencies: DataFrame, terms: list[str], text: Column, score_col: str = "score", out_col: str = "specificity") -> DataFrame:
    """``ranked`` with the sum over groups of kindred terms of the rarest one present, plus a thousandth of the score.

    Terms are looked for whole among the text's identifier parts, so one that holds a separator is never present.
    """
    place = {t: i for i, t in enumerate(terms)}
    own = once(ranked, {"_parts": X.lexical_tokens(text)}).crossJoin(F.broadcast(frequencies))  # one row

    def worth(term: str) -> Column:
        rare = F.log((F.col("_units") + 1) / (F.col(f"_d{place[term]}") + 1)) + 1.0
        return F.when(F.array_contains("_parts", term), rare).otherwise(0.0)

    groups = [F.greatest(*map(worth, g), F.lit(0.0)) for g in X.term_groups(terms)]
    total = reduce(lambda a, b: a + b, groups, F.lit(0.0))
    return own.select(*ranked.columns, (total + F.col(score_col) * 0.001).alias(out_col))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector divided by its length, or by 1e-12 if that is less."""
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x / norm)


def vector_top(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` vectors with the largest product with ``query``, exactly; ties by id."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return top(vectors.select(id_col, dot(F.col(vector_col), literal).alias("score")), k, F.desc("score"), F.col(id_col))


def fuse(rankings: list[tuple[DataFrame, float]], id_col: str, rank_col: str = "rank", k: int = V.FUSION_K, score_col: str = "score") -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the rankings that have the id."""
    parts = [r.select(id_col, (F.lit(w) / (k + F.col(rank_col))).alias("_part")) for r, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("_part").alias(score_col))


def fuse_lists(lists: list[list[str]], weights: list[float] | None = None, k: int = V.FUSION_K) -> list[str]:
    """The same for a few short lists at hand; ties by name."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("there must be a weight for each ranking")
    if any(w < 0 for w in weights):
        raise ValueError("weights can't be negative")
    total: dict[str, float] = {}
    for names, weight in zip(lists, weights):
        for rank, name in enumerate(dict.fromkeys(names), 1):
            total[name] = total.get(name, 0.0) + weight / (k + rank)
    return sorted(total, key=lambda x: (-total[x], x))


def authority_weight(authority: Column) -> Column:
    out = F.lit(V.OTHER_RETRIEVAL_WEIGHT)
    for name, weight in V.RETRIEVAL_WEIGHTS.items():
        out = F.when(authority == name, weight).otherwise(out)
    return out


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, sample_col: str, item_col: str, k: int, rank_col: str = "rank") -> DataFrame:
    """Per sample of ``gold``: n_gold, found (within k), recall, reciprocal_rank, all_found. Null gold items count as none; without gold the recall is 1."""
    pairs = gold.join(ranked.select(sample_col, item_col, rank_col), [sample_col, item_col], "left")
    near = F.col(rank_col) <= k
    out = pairs.groupBy(sample_col).agg(F.count(item_col).alias("n_gold"), F.count_if(near).alias("found"), F.min(rank_col).alias("_first"))
    return out.select(
        sample_col,
        "n_gold",
        "found",
        F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("found") / F.col("n_gold")).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("found") == F.col("n_gold")).alias("all_found"),
    )


def strata(metrics: DataFrame, flags: list[str], measures: list[str]) -> DataFrame:
    """stratum, samples and the mean of each measure, over all rows and over those of each flag."""
    rows = metrics.withColumn("stratum", F.explode(F.filter(F.array(F.lit("all"), *(F.when(F.col(f), F.lit(f)) for f in flags)), lambda x: x.isNotNull())))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("samples"), *(F.avg(m).alias(m) for m in measures))


def fuzzy(symbols: DataFrame, name: str, columns: list[str], least: float = 0.48, k: int = 5, order: list[str] | None = None) -> DataFrame:
    """The ``k`` rows whose best sequence-matcher ratio over ``columns`` is ``least`` or more, with match_score, best first."""
    needle = name.casefold()

    @F.pandas_udf("double")
    def ratio(rows: pd.DataFrame) -> pd.Series:
        def one(own: tuple) -> float:
            return max(difflib.SequenceMatcher(None, needle, (x or "").casefold()).ratio() for x in own)

        return pd.Series([one(own) for own in rows.itertuples(index=False)], dtype="float64")

    scored = symbols.withColumn("_ratio", ratio(F.struct(*columns))).where(F.col("_ratio") >= least)
    return scored.orderBy(F.desc("_ratio"), *(order or columns)).limit(k).withColumn("match_score", F.round("_ratio", 3)).drop("_ratio")
