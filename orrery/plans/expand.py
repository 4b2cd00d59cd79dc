"""Bounded expansion of a typed graph around seed files, level by level."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators.graph import relation_weight

FACT = ["direction", "source", "source_symbol", "relation", "target", "target_path", "target_symbol", "line", "resolution", "depth"]
MOST_CONSUMERS = 120


@dataclass
class Expansion:
    """scores: path, score. reasons: path, place and the reason's fields. facts: the fields in FACT and place. place orders rows as found."""

    scores: DataFrame
    reasons: DataFrame
    facts: DataFrame


def _stems(words: Column) -> Column:
    def ends(x: Column) -> Column:
        cut = lambda end, least: F.when(x.endswith(end) & (F.length(x) >= least), F.substring(x, F.lit(1), F.length(x) - len(end)))
        return F.filter(F.array(cut("ing", 7), cut("al", 7), cut("s", 5)), lambda y: y.isNotNull())

    return F.flatten(F.transform(words, ends))


def family(text: Column) -> Column:
    """What a name's words may match, as functions.text.term_family() gives it for a question."""
    ignored = F.array(*map(F.lit, V.STOPWORDS + V.NOISE_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\w[\w.-]*)"), F.lit(1)), lambda x: (F.length(x) > 1) & ~F.array_contains(ignored, x))
    base = F.concat(X.lexical_tokens(text), words, _stems(words))
    return F.array_distinct(F.concat(base, _stems(base)))


class Question:
    """A question's terms, and what of a graph they match."""

    def __init__(self, question: str):
        self.terms = sorted(X.term_family(question)) if question else []

    def __bool__(self) -> bool:
        return bool(self.terms)

    def shared(self, name: Column) -> Column:
        return F.array_intersect(family(F.coalesce(name, F.lit(""))), F.array(*map(F.lit, self.terms)) if self.terms else F.array().cast("array<string>"))

    def names(self, name: Column) -> Column:
        return F.size(self.shared(name)) > 0

    def calls(self, name: Column) -> Column:
        """At least two terms, one of them not generic."""
        both = self.shared(name)
        return (F.size(both) >= 2) & (F.size(F.array_except(both, F.array(*map(F.lit, V.GENERIC_SQL_TERMS)))) > 0)

    def affinity(self, chunks: DataFrame, paths: DataFrame) -> DataFrame:
        """path and affinity: how many terms occur in the path or, lower-cased before it is split, in its content."""
        terms = F.array(*map(F.lit, self.terms))
        inside = chunks.select("path", F.explode(F.array_intersect(X.lexical_tokens(F.lower("content")), terms)).alias("_t"))
        named = paths.select("path", F.explode(F.array_intersect(X.lexical_tokens(F.col("path")), terms)).alias("_t"))
        return inside.unionByName(named).groupBy("path").agg(F.count_distinct("_t").alias("affinity"))


def active_functions(symbols: DataFrame, authority: DataFrame, question: Question) -> DataFrame:
    """name of the active SQL functions in migrations that the question calls for."""
    own = symbols.where("kind = 'function' AND active = 1").join(authority.where("authority = 'schema_history'").select("path"), "path", "left_semi")
    name = F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("name"))
    return own.select(name.alias("name")).where(question.calls(F.col("name"))).distinct()


def _rows(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """The frontier's edges with _at (the frontier's path), _way (how it was reached first), direction and _row, their order."""
    out = direction == "outgoing"
    at = frontier.select(F.col("path").alias("_at"), "_way")
    rows = edges.join(at, F.col("source_path" if out else "target_path") == F.col("_at"))
    order = _row("" if out else F.col("source_path"), F.col("line"), F.col("relation"), F.col("target_name") if out else "", F.col("id"))
    return rows.withColumn("direction", F.lit(direction)).withColumn("_row", order)


def _row(*values) -> Column:
    """The order of a row among those of one path and side."""
    kinds = ("string", "int", "string", "string", "bigint")
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(f"_k{k}") for k, (v, t) in enumerate(zip(values, kinds))))


def _step(rank: Column, side, row: Column) -> Column:
    return F.struct(rank.cast("long").alias("rank"), (side if isinstance(side, Column) else F.lit(side)).cast("int").alias("side"), row.alias("row"))


def expand(edges: DataFrame, authority: DataFrame, seeds: DataFrame, depth: int = 2, question: str = "", ranges: DataFrame | None = None, chunks: DataFrame | None = None, symbols: DataFrame | None = None) -> Expansion:
    """Scores, reasons and facts around ``seeds`` (path, rank from 0).

    edges: id, source_path, source_name, source_qualified_name, relation, target_name, target_path, target_qualified_name, line,
    resolution_confidence; authority: path, authority; ranges: path, range_start, range_end of the seeds' changed lines;
    chunks (path, content) serve the question, symbols also the ranges. Seeds start at 100 less their rank; a neighbour
    scores by how far it is, what relation leads there and how well it fits the question, and keeps its best score. Edges
    of seeds outside the ranges don't count; imports are taken but not followed. Files that share a resource with what was
    found are reached through it, the less the more there are.
    """
    asked = Question(question)
    of = authority.select("path", "authority")
    if asked:
        if chunks is None or symbols is None:
            raise ValueError("a question needs chunks and symbols")
        affinity = asked.affinity(chunks, authority.select("path"))
    else:
        affinity = authority.select("path", F.lit(0).cast("long").alias("affinity")).limit(0)

    def with_path(rows: DataFrame, column: str, source: DataFrame, value: str, name: str) -> DataFrame:
        return rows.join(source.select(F.col("path").alias(column), F.col(value).alias(name)), column, "left")

    edges = edges.where(F.col("relation").isin(list(V.RELATION_WEIGHTS)))
    # _goes.. columns hold, for each edge, what the question makes of its target.
    named, called = (asked.names(F.col("target_name")), asked.calls(F.col("target_name"))) if asked else (F.lit(False), F.lit(False))
    # A place tells the level and, for each step on the way there, in what order it was taken.
    frontier = seeds.select("path", F.array(_step(F.col("rank"), 0, _row("", 0, "", "", 0))).alias("_way"))
    scores = [seeds.select("path", (F.lit(100.0) - F.col("rank")).alias("score"))]
    reasons, facts, resources = [], [], []
    if asked:
        resources.append(active_functions(symbols, authority, asked).select(F.lit("callable").alias("family"), F.col("name").alias("target")))
    for level in range(depth):
        rows = _rows(edges, frontier, "outgoing").unionByName(_rows(edges, frontier, "incoming"))
        if level == 0 and ranges is not None:
            by_path = ranges.groupBy(F.col("path").alias("_at")).agg(F.collect_list(F.struct("range_start", "range_end")).alias("_ranges"))
            rows = rows.join(by_path, "_at", "left")
            inside = F.exists("_ranges", lambda r: F.col("line").between(r["range_start"], r["range_end"]))
            rows = rows.where((F.col("direction") == "incoming") | F.col("_ranges").isNull() | inside)
            if symbols is not None:
                hit = (F.col("s.path") == F.col("r.path")) & (F.col("s.start_line") <= F.col("r.range_end")) & (F.col("s.end_line") >= F.col("r.range_start"))
                touched = symbols.alias("s").join(ranges.alias("r"), hit).groupBy(F.col("s.path").alias("_at")).agg(F.flatten(F.collect_set(F.array("s.name", "s.qualified_name"))).alias("_names"))
                rows = rows.join(touched, "_at", "left")
                full = F.when(F.coalesce("target_qualified_name", F.lit("")) != "", F.col("target_qualified_name")).otherwise(F.col("target_name"))
                rows = rows.where((F.col("direction") == "outgoing") | F.col("_names").isNull() | F.array_contains("_names", full) | F.array_contains("_names", F.col("target_name")))
        rows = with_path(with_path(rows, "_at", of, "authority", "_of_at"), "source_path", of, "authority", "_of_source")
        callable_ = F.col("relation").isin(V.CALLABLE_RELATIONS)
        if asked and level == 0:
            rows = rows.where(~((F.col("direction") == "incoming") & F.coalesce(F.col("_of_at") == "schema_history", F.lit(False)) & callable_ & ~called))
        step = _step(F.lit(0), (F.col("direction") == "incoming").cast("int"), F.col("_row"))
        place = F.struct(F.lit(level).alias("level"), F.concat("_way", F.array(step)).alias("way"))
        rows = rows.withColumn("_place", place)
        facts.append(rows.select(*_fact(F.col("direction"), F.lit(level + 1)), "_place"))
        public = F.col("relation").isin(V.RESOURCE_RELATIONS) & C.shareable(F.col("relation"), F.col("target_name"), F.col("resolution_confidence"))
        history = F.coalesce(F.col("_of_source") == "schema_history", F.lit(False))
        fits = F.lit(True) if not asked else ~history | F.when(callable_, called).otherwise(named)
        resources.append(rows.where(public & fits).select(C.resource_family(F.col("relation")).alias("family"), F.col("target_name").alias("target")))
        rows = rows.withColumn("_to", F.when(F.col("direction") == "outgoing", F.col("target_path")).otherwise(F.col("source_path"))).where("_to IS NOT NULL AND _to <> '' AND _to <> _at")
        rows = with_path(with_path(rows, "_to", of, "authority", "_of_to"), "_to", affinity, "affinity", "_affinity").where(F.col("_of_to").isin(V.AUTHORITIES)).withColumn("_affinity", F.coalesce("_affinity", F.lit(0)))
        if asked:
            rows = rows.where(~((F.col("direction") == "outgoing") & F.col("relation").isin("imports", "calls") & (F.col("_affinity") == 0) & ~named))
            seen_from = F.when(public, F.col("_of_source")).otherwise(F.col("_of_at"))
            rows = rows.where(~((F.col("relation") == "calls_sql") & F.coalesce(seen_from == "schema_history", F.lit(False)) & (F.col("_of_to") == "schema_history") & ~called))
        base = 80.0 if level == 0 else 62.0
        value = F.lit(base) + relation_weight(F.col("relation")) / (2.0 * (level + 1)) + F.least(F.col("_affinity") * 3.0, F.lit(15.0))
        scores.append(rows.select(F.col("_to").alias("path"), value.alias("score")))
        reasons.append(rows.select(F.col("_to").alias("path"), F.lit("graph_edge").alias("kind"), F.col("_at").alias("from"), "relation", "direction", F.lit(level + 1).alias("depth"), F.col("resolution_confidence").alias("resolution"), *_no("resource_family", "resource"), F.lit(None).cast("long").alias("consumer_count"), "_place"))
        went = rows.where("relation <> 'imports'").groupBy(F.col("_to").alias("path")).agg(F.min("_place").alias("_first"))
        frontier = went.select("path", F.col("_first.way").alias("_way"))
    found = reduce(DataFrame.unionByName, resources).distinct()
    users = edges.where(F.col("relation").isin(V.RESOURCE_RELATIONS)).withColumn("family", C.resource_family(F.col("relation"))).join(found.withColumnRenamed("target", "target_name"), ["family", "target_name"])
    window = W.partitionBy("family", "target_name").orderBy("source_path", "line", "id")
    users = users.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= MOST_CONSUMERS)
    users = users.join(users.groupBy("family", "target_name").agg(F.count(F.lit(1)).alias("_count")), ["family", "target_name"])
    users = with_path(with_path(users, "source_path", of, "authority", "_of_to"), "source_path", affinity, "affinity", "_affinity").where(F.col("_of_to").isin(V.AUTHORITIES))
    penalty = F.least(F.lit(30.0), 6.0 * F.greatest(F.lit(0.0), F.log2(F.col("_count") / 8.0)))
    row = _row(F.concat("family", F.lit("\0"), "target_name"), F.col("_n"), "", "", F.col("id"))
    users = users.withColumn("_place", F.struct(F.lit(depth).alias("level"), F.array(_step(F.lit(0), 0, row)).alias("way")))
    scores.append(users.select(F.col("source_path").alias("path"), (88.0 + F.least(F.coalesce("_affinity", F.lit(0)) * 3.0, F.lit(15.0)) - 1.5 * penalty).alias("score")))
    reasons.append(users.select(F.col("source_path").alias("path"), F.lit("shared_resource").alias("kind"), *_no("from", "relation", "direction"), F.lit(None).cast("int").alias("depth"), *_no("resolution"), F.col("family").alias("resource_family"), F.col("target_name").alias("resource"), F.col("_count").alias("consumer_count"), "_place"))
    facts.append(users.select(*_fact(F.lit("shared_resource"), F.lit(1)), "_place"))

    best = reduce(DataFrame.unionByName, scores).groupBy("path").agg(F.max("score").alias("score"))
    key = ["source", "relation", "target", "target_path", "line", "direction"]
    rest = [c for c in FACT if c not in key]
    # Of equal facts the first found stays; its other fields come with it.
    firsts = reduce(DataFrame.unionByName, facts).groupBy(*key).agg(F.min(F.struct("_place", *rest)).alias("_first")).select(*key, F.col("_first._place").alias("place"), *(F.col(f"_first.{c}").alias(c) for c in rest))
    all_reasons = reduce(DataFrame.unionByName, reasons)
    own = [c for c in all_reasons.columns if c != "_place"]
    return Expansion(best, all_reasons.groupBy(*own).agg(F.min("_place").alias("place")), firsts.select(*FACT, "place"))


def _no(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def _fact(direction: Column, depth: Column) -> list[Column]:
    symbol = F.when(F.coalesce("source_qualified_name", F.lit("")) != "", F.col("source_qualified_name")).otherwise(F.col("source_name"))
    values = [direction, F.col("source_path"), symbol, F.col("relation"), F.col("target_name"), F.col("target_path"), F.col("target_qualified_name"), F.col("line"), F.col("resolution_confidence"), depth]
    return [v.alias(n) for v, n in zip(values, FACT)]
