"""Joins, groupings and set operations on symbols, edges, chunks and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def same_row(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))


def mark_latest(rows: DataFrame, key: Column, order: list[str], out_col: str = "active") -> DataFrame:
    """``rows`` with 1 for the last of each key by ``order`` and 0 for the others.

    The last is found by an aggregate that combines before the shuffle, so a key with very many rows is no task of its own.
    """
    keyed = rows.withColumn("_key", key)
    last = keyed.groupBy(F.col("_key").alias("_of")).agg(F.max(F.struct(*order)).alias("_last"))
    return keyed.join(last, F.col("_key").eqNullSafe(F.col("_of"))).drop("_of").withColumn(out_col, F.struct(*order).eqNullSafe(F.col("_last")).cast("int")).drop("_key", "_last")


def unique_targets(definitions: DataFrame, keys: list[Column], path_col: str, value_col: str, order_col: str) -> DataFrame:
    """_key, path and value of the keys that definitions of exactly one path have; of several values the last by ``order_col``."""
    own = definitions.withColumn("_key", F.explode(F.array_distinct(F.array(*keys))))
    by_key = own.groupBy("_key").agg(F.min(path_col).alias("_low"), F.max(path_col).alias("_high"), F.max_by(value_col, order_col).alias("_value"))
    return by_key.where("_low = _high").select("_key", F.col("_low").alias("_path"), "_value")


def link_targets(edges: DataFrame, targets: DataFrame, name: Column, open_: Column, path_col: str, value_col: str, confidence_col: str, confidence: str) -> DataFrame:
    """``edges`` with path, value and confidence set where ``open_`` holds and the name has a unique target."""
    found = edges.withColumn("_key", F.when(open_, name)).join(targets, "_key", "left")
    hit = F.col("_path").isNotNull()
    changed = {path_col: F.coalesce("_path", path_col), value_col: F.when(hit, F.col("_value")).otherwise(F.col(value_col)), confidence_col: F.when(hit, confidence).otherwise(F.col(confidence_col))}
    return found.withColumns(changed).select(*edges.columns)


def overlapping(intervals: DataFrame, ranges: DataFrame, key: str, start: str, end: str, range_start: str = "range_start", range_end: str = "range_end") -> DataFrame:
    """Rows of ``intervals`` that share a place with a range of the same key; both ends count."""
    hit = (F.col(f"i.{key}") == F.col(f"r.{key}")) & (F.col(f"i.{start}") <= F.col(f"r.{range_end}")) & (F.col(f"i.{end}") >= F.col(f"r.{range_start}"))
    return intervals.alias("i").join(ranges.alias("r"), hit, "left_semi")


def fact_groups(edges: DataFrame, keys: list[str], line_col: str, collected: dict[str, str] | None = None) -> DataFrame:
    """Per key: occurrences (of distinct lines), first_line, lines (ascending), and the sorted distinct values of other columns by new name."""
    sets = [F.array_sort(F.collect_set(c)).alias(name) for name, c in (collected or {}).items()]
    out = edges.groupBy(*keys).agg(F.array_sort(F.collect_set(line_col)).alias("lines"), *sets)
    return out.withColumn("occurrences", F.size("lines").cast("long")).withColumn("first_line", F.element_at("lines", 1))


def shared_consumers(edges: DataFrame, resource: str, consumer: str, order: list[str], most: int = 120) -> DataFrame:
    """Resource, consumer and consumer_count (edges of the resource, at most ``most``) with a penalty that grows from eight on.

    Only a resource's first ``most`` edges by ``order`` count: a limit of the analysis itself. Rows beyond it are cut
    within their partition before the shuffle.
    """
    first = edges.withColumn("_n", F.row_number().over(W.partitionBy(resource).orderBy(*order))).where(F.col("_n") <= most)
    count = first.groupBy(resource).agg(F.count(F.lit(1)).alias("consumer_count"))
    penalty = F.least(F.lit(30.0), 6.0 * F.greatest(F.lit(0.0), F.log2(F.greatest(F.lit(1), F.col("consumer_count")) / 8.0)))
    return first.select(resource, consumer).distinct().join(count, resource).withColumn("penalty", penalty)


def same_name(changed: DataFrame, symbols: DataFrame, name: str, path: str, order: list[str], per_symbol: int = 12) -> DataFrame:
    """For each changed symbol the first ``per_symbol`` symbols of the same name, A-Z folded, on other paths, as existing_*.

    Symbols are ranked before the join: the first ``per_symbol`` of a name and path, then the first 2 * ``per_symbol`` of
    the name. A symbol's own path holds at most half of these, so the rest has all that it may get, and no more pairs
    than that are made for it.
    """
    there = symbols.withColumn("_name", F.lower(name)).where(F.col("_name").isNotNull() & F.col(path).isNotNull())
    own = there.withColumn("_n", F.row_number().over(W.partitionBy("_name", path).orderBy(*order))).where(F.col("_n") <= per_symbol)
    first = own.withColumn("_n", F.row_number().over(W.partitionBy("_name").orderBy(*order))).where(F.col("_n") <= 2 * per_symbol)
    other = first.select("_name", *(F.col(c).alias(f"existing_{c}") for c in symbols.columns))
    pairs = changed.join(other, (F.lower(name) == F.col("_name")) & (F.col(path) != F.col(f"existing_{path}"))).drop("_name")
    window = W.partitionBy(*changed.columns).orderBy(*(f"existing_{c}" for c in order))
    return pairs.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= per_symbol).drop("_n")


def snapshot_delta(before: DataFrame, after: DataFrame, identity: list[str], semantic: list[str], citation: list[str] | None = None) -> DataFrame:
    """The signed changes between two states: identity, change, sign, changed_fields, before, after.

    added and removed rows are on one side only; a row with other semantic fields is modified, one with other citation
    fields alone is relocated; equal rows give nothing.
    """
    fields = semantic + (citation or [])
    one = before.select(*identity, F.struct(*fields).alias("before"))
    two = after.select(*identity, F.struct(*fields).alias("after"))
    both = one.join(two, identity, "full_outer")
    differs = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in fields]
    both = both.withColumn("_fields", F.filter(F.array(*differs), lambda x: x.isNotNull()))
    gone, new = F.col("after").isNull(), F.col("before").isNull()
    change = F.when(gone, "removed").when(new, "added").when(F.arrays_overlap("_fields", F.array(*map(F.lit, semantic))), "modified").when(F.size("_fields") > 0, "relocated")
    out = both.withColumn("change", change).where(F.col("change").isNotNull())
    none = F.array().cast("array<string>")
    return out.select(*identity, "change", F.when(gone, -1).when(new, 1).otherwise(0).alias("sign"), F.when(gone | new, none).otherwise(F.col("_fields")).alias("changed_fields"), "before", "after")


def rename_candidates(removed: DataFrame, added: DataFrame, shape: list[str], path: str, name: str) -> DataFrame:
    """Pairs of a removed and an added symbol that alone on their side have a shape: before_*, after_* and change."""

    def alone(rows: DataFrame, side: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in shape]
        firsts = [F.first(c).alias(f"{side}_{c}") for c in rest]
        return rows.groupBy(*shape).agg(F.count(F.lit(1)).alias("_n"), *firsts).where("_n = 1").drop("_n")

    pairs = alone(removed, "before").join(alone(added, "after"), shape)
    same_path, same = F.col(f"before_{path}") == F.col(f"after_{path}"), F.col(f"before_{name}") == F.col(f"after_{name}")
    return pairs.withColumn("change", F.when(same_path & ~same, "rename_candidate").when(~same_path & same, "move_candidate").otherwise("identity_replacement_candidate"))


def digests_by_key(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and digest: SHA-256 over the sorted digests of the key's rows as JSON objects of ``columns``, whatever their order."""
    own = rows.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("_h"))
    return own.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ","), 256).alias("digest"))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place of a row among those of the same key, from 0."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1)


def publish_chunks(existing: DataFrame, desired: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """The multiset difference of two sets of chunks: key columns, ``id_col`` (null for new ones) and action: keep, insert or delete.

    Equal chunks are matched one to one, the largest id first; what the old side has more goes, what the new side has more comes.
    """
    had = existing.groupBy(*key).agg(F.count(F.lit(1)).alias("_old"))
    wanted = desired.groupBy(*key).agg(F.count(F.lit(1)).alias("_new"))
    surplus = F.greatest(F.lit(0), F.col("_old") - F.coalesce("_new", F.lit(0)))
    counts = had.join(wanted, key, "full_outer")
    come = counts.select(*key, F.explode(F.expr("CASE WHEN _new > coalesce(_old, 0) THEN sequence(1, _new - coalesce(_old, 0)) ELSE array() END"))).select(*key, F.lit(None).cast(existing.schema[id_col].dataType).alias(id_col), F.lit("insert").alias("action"))
    there = existing.select(*key, id_col).join(counts.where("_old IS NOT NULL").select(*key, "_old", "_new", surplus.alias("_surplus")), key, "left")
    there = there.withColumns({"_old": F.coalesce("_old", F.lit(1)), "_surplus": F.coalesce("_surplus", F.lit(1))})  # keys with nulls equal none
    part = (F.col("_surplus") > 0) & (F.col("_surplus") < F.col("_old"))
    whole = there.where(~part).select(*key, id_col, F.when(F.col("_surplus") > 0, "delete").otherwise("keep").alias("action"))
    # Only where some of equal chunks go does it matter which: the smallest ids.
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col(id_col)))
    some = there.where(part).withColumn("_n", place).select(*key, id_col, F.when(F.col("_n") <= F.col("_surplus"), "delete").otherwise("keep").alias("action"))
    return whole.unionByName(some).unionByName(come)


def symbols_at(symbols: DataFrame, ranges: DataFrame, path: str, start: str, end: str, active: str, order: list[str], most: int = 4) -> DataFrame:
    """The first ``most`` symbols of each path that overlap a range of it: active ones first, then those with least of them in it. Ranges have columns ``path``, range_start, range_end."""
    both = symbols.join(ranges, path).where((F.col(start) <= F.col("range_end")) & (F.col(end) >= F.col("range_start")))
    overlap = F.least(end, "range_end") - F.greatest(start, "range_start")
    window = W.partitionBy(path).orderBy(F.desc(active), overlap, *order)
    return both.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= most)


def missing_vectors(chunks: DataFrame, vectors: DataFrame, id_col: str, vector_id_col: str, of_model: Column | None = None) -> DataFrame:
    """Chunks without a vector (of the model, if one is asked for)."""
    own = (vectors if of_model is None else vectors.where(of_model)).select(F.col(vector_id_col).alias("_id"))
    return chunks.join(own, F.col(id_col) == F.col("_id"), "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame, id_col: str, vector_id_col: str) -> DataFrame:
    """One row: chunks, embedded_chunks, semantic_coverage (4 places; 1 if there are none) and pending_chunks."""
    own = vectors.select(F.col(vector_id_col).alias("_id"), F.lit(1).alias("_has"))
    found = chunks.join(own, F.col(id_col) == F.col("_id"), "left").agg(F.count_distinct(id_col).alias("chunks"), F.count("_has").alias("embedded_chunks"))
    share = F.when(F.col("chunks") > 0, F.round(F.col("embedded_chunks") / F.col("chunks"), 4)).otherwise(1.0)
    return found.withColumn("semantic_coverage", share).withColumn("pending_chunks", F.greatest(F.lit(0), F.col("chunks") - F.col("embedded_chunks")))
