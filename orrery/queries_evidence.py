"""More operators over the driver's tables: classes and names, links, variants of the graph, ranges, resources, two states.

They are added to ``queries.QUERIES`` as this module is imported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as C
from .functions import text as X
from .functions import vocabulary as V
from .operators import graph as G
from .operators import ranking as R
from .operators import relational as L
from .operators import schedule as S
from .plans import expand as E
from .plans import twin as T
from .queries import ORACLES, SHAPES, _authority, _edges, _query, _read
from .sources import ingest as I

_CLASS_SQL = ORACLES["classify_paths"]
_TABLE = lambda names: ", ".join(f"'{x}'" for x in names)


def _shaped(key: str):
    return F.replace(F.get(F.array(*map(F.lit, SHAPES)), (F.col(key) % len(SHAPES)).cast("int")), F.lit("{}"), F.col(key).cast("string"))


# Names and classes


@_query(
    f"""
WITH p AS (SELECT doc_id, replace([{_TABLE(SHAPES)}][(doc_id % {len(SHAPES)} + 1)::INT], '{{}}', doc_id::VARCHAR) AS path FROM documents),
t AS (SELECT doc_id, path, ({" OR ".join(f"contains('/' || lower(path), '{m}')" for m in C.TEST_MARKS)}) AS is_test, regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) AS suffix FROM p)
SELECT doc_id, path, is_test, CASE WHEN is_test THEN 'test' {" ".join(f"WHEN suffix IN ({_TABLE(x)}) THEN '{n}'" for n, x in C.LAYERS.items())} WHEN suffix <> '' THEN suffix ELSE 'unknown' END AS layer FROM t
"""
)
def path_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", _shaped("doc_id").alias("path"))
    return rows.select("doc_id", "path", C.is_test(F.col("path")).alias("is_test"), C.layer(F.col("path")).alias("layer"))


_RELATIONS = [*V.RELATION_WEIGHTS]


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.get(F.array(*map(F.lit, _RELATIONS)), (F.col("p_partkey") % len(_RELATIONS)).cast("int"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("public."), "p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("")
    resolution = F.when(F.col("p_partkey") % 4 < 2, "active_sql").otherwise("lexical")
    return _read(spark, sf_dir, "part").select("p_partkey", relation.alias("relation"), target.alias("target"), resolution.alias("resolution"))


_RESOURCES_SQL = f"""r AS (SELECT p_partkey, [{_TABLE(_RELATIONS)}][(p_partkey % {len(_RELATIONS)} + 1)::INT] AS relation,
  CASE p_partkey % 3 WHEN 0 THEN 'public.' || p_name WHEN 1 THEN p_name ELSE '' END AS target, CASE WHEN p_partkey % 4 < 2 THEN 'active_sql' ELSE 'lexical' END AS resolution FROM part)"""


@_query(
    f"""
WITH {_RESOURCES_SQL}
SELECT p_partkey, relation, CASE WHEN relation LIKE '%\\_table' ESCAPE '\\' THEN 'table' WHEN relation IN ('calls_rpc', 'calls_sql') THEN 'callable' ELSE 'edge_function' END AS family,
  CASE WHEN relation LIKE '%\\_table' ESCAPE '\\' OR relation = 'calls_rpc' THEN starts_with(target, 'public.') WHEN relation = 'calls_sql' THEN starts_with(target, 'public.') AND resolution = 'active_sql' ELSE relation = 'invokes_edge_function' AND target <> '' END AS linked,
  CASE WHEN relation LIKE '%\\_table' ESCAPE '\\' OR relation IN ('calls_rpc', 'calls_sql') THEN starts_with(target, 'public.') ELSE relation = 'invokes_edge_function' AND target <> '' END AS public FROM r
"""
)
def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation, target = F.col("relation"), F.col("target")
    return _resources(spark, sf_dir).select("p_partkey", "relation", C.resource_family(relation).alias("family"), C.shareable(relation, target, F.col("resolution")).alias("linked"), C.shareable(relation, target).alias("public"))


QUESTION = "Which red bolts and casings are listed for the stations in ECONOMY?"
_STEMS_SQL = lambda x: f"flatten(list_transform({x}, lambda w: list_filter([CASE WHEN ends_with(w, 'ing') AND length(w) >= 7 THEN w[:-4] END, CASE WHEN ends_with(w, 'al') AND length(w) >= 7 THEN w[:-3] END, CASE WHEN ends_with(w, 's') AND length(w) >= 5 THEN w[:-2] END], lambda y: y IS NOT NULL)))"
_PARTS_SQL = lambda x: f"list_filter(flatten(list_transform(regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_-]+'), lambda q: regexp_split_to_array(q, '[_-]+'))), lambda q: q <> '')"
_FAMILY_SQL = f"""
n AS (SELECT p_partkey, p_name || ' casings-' || p_type || 'RedSignal_settings the station.als' AS x FROM part),
b AS (SELECT p_partkey, {_PARTS_SQL("x")} AS parts, list_filter(regexp_extract_all(lower(x), '\\w[\\w.-]*'), lambda w: length(w) > 1 AND w NOT IN ({_TABLE(V.STOPWORDS + V.NOISE_WORDS)})) AS words FROM n),
c AS (SELECT p_partkey, parts || words || {_STEMS_SQL("words")} AS base FROM b),
fam AS (SELECT p_partkey, list_distinct(base || {_STEMS_SQL("base")}) AS family FROM c)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" casings-"), "p_type", F.lit("RedSignal_settings the station.als")).alias("x"))


@_query(f"WITH {_FAMILY_SQL} SELECT p_partkey, array_to_string(list_sort(family), ' ') AS family FROM fam")
def term_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(E.family(F.col("x"))), " ").alias("family"))


_ASKED = E.Question(QUESTION)


@_query(
    f"""
WITH {_FAMILY_SQL}, s AS (SELECT p_partkey, list_filter(family, lambda w: w IN ({_TABLE(_ASKED.terms)})) AS shared FROM fam)
SELECT p_partkey, array_to_string(list_sort(shared), ' ') AS shared, len(shared) > 0 AS names, len(shared) >= 2 AND len(list_filter(shared, lambda w: w NOT IN ({_TABLE(V.GENERIC_SQL_TERMS)}))) > 0 AS calls FROM s
"""
)
def question_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _named(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(_ASKED.shared(x)), " ").alias("shared"), _ASKED.names(x).alias("names"), _ASKED.calls(x).alias("calls"))


_TEXT_QUESTION = E.Question("Is the apache license version of the trash or clown reading listed?")


@_query(
    f"""
WITH d AS (SELECT source || '/' || lang || '/' || (doc_id % 50) AS path, lower(text) AS content FROM documents),
t AS (SELECT path, unnest({_PARTS_SQL("content")}) AS term FROM d UNION SELECT path, unnest({_PARTS_SQL("path")}) FROM d)
SELECT path, count(DISTINCT term) AS affinity FROM t WHERE term IN ({_TABLE(_TEXT_QUESTION.terms)}) GROUP BY path
"""
)
def path_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chunks = docs.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("text").alias("content"))
    return _TEXT_QUESTION.affinity(chunks, chunks.select("path").distinct())


@_query(
    f"""
WITH cls AS ({_CLASS_SQL}), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, authority, round(list_dot_product(e.embedding::DOUBLE[], q), 6) AS score FROM embeddings e JOIN cls ON doc_id = vec_id, q
WHERE authority IN ({_TABLE(V.AUTHORITIES)}) ORDER BY list_dot_product(e.embedding::DOUBLE[], q) DESC, vec_id LIMIT 25
"""
)
def vectors_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()[0]  # one vector
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), C.source_class(_shaped("doc_id"))["authority"].alias("authority"))
    own = vectors.join(files.where(F.col("authority").isin(V.AUTHORITIES)), "vec_id")
    best = R.vector_top(own.select("vec_id", "embedding"), query, 25, "vec_id", "embedding")
    return best.join(files, "vec_id").select("vec_id", "authority", F.round("score", 6).alias("score"))


@_query(
    f"""
WITH cls AS ({_CLASS_SQL}), s AS (SELECT p_partkey, p_name, coalesce(authority, 'unknown') AS authority FROM part LEFT JOIN cls ON doc_id = p_partkey)
SELECT authority, count(*) AS symbols, count(DISTINCT p_name) AS names FROM s GROUP BY authority
"""
)
def symbols_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), C.source_class(_shaped("doc_id"))["authority"].alias("authority"))
    symbols = _read(spark, sf_dir, "part").select("p_partkey", "p_name").join(files, "p_partkey", "left").withColumn("authority", F.coalesce("authority", F.lit("unknown")))
    return symbols.groupBy("authority").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("p_name").alias("names"))


@_query(
    """
WITH y AS (SELECT 's/' || l_suppkey AS path, l_orderkey * 10 + l_linenumber AS id, l_linenumber * 10 + l_orderkey % 7 AS start_line, l_linenumber * 10 + l_orderkey % 7 + l_quantity::BIGINT AS end_line, (l_linestatus = 'O')::INT AS active FROM lineitem),
r AS (SELECT 's/' || s_suppkey AS path, 20 + s_suppkey % 10 AS range_start, 35 + s_suppkey % 10 AS range_end FROM supplier),
o AS (SELECT y.path, id, start_line, end_line, active, row_number() OVER (PARTITION BY y.path ORDER BY active DESC, least(end_line, range_end) - greatest(start_line, range_start), start_line, id, end_line) AS n
  FROM y JOIN r ON y.path = r.path AND start_line <= range_end AND end_line >= range_start)
SELECT path, n, id, start_line, end_line FROM o WHERE n <= 4
"""
)
def anchor_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _read(spark, sf_dir, "lineitem").selectExpr("concat('s/', l_suppkey) AS path", "l_orderkey * 10 + l_linenumber AS id", "l_linenumber * 10 + l_orderkey % 7 AS start_line", "int(l_linestatus = 'O') AS active", "bigint(l_quantity) AS n_lines")
    ranges = _read(spark, sf_dir, "supplier").selectExpr("concat('s/', s_suppkey) AS path", "20 + s_suppkey % 10 AS range_start", "35 + s_suppkey % 10 AS range_end")
    found = L.symbols_at(symbols.withColumn("end_line", F.col("start_line") + F.col("n_lines")), ranges, "path", "start_line", "end_line", "active", ["start_line", "id", "end_line"])
    return found.select("path", F.col("_n").cast("long").alias("n"), "id", "start_line", "end_line")


@_query(
    """
WITH m AS (SELECT lower(p_brand) || '.' || lower(p_type) || '.' || replace(lower(p_name), ' ', '_') || (p_partkey % 40) AS module, 'm/' || p_partkey AS path, p_partkey AS ordinal FROM part),
x AS (SELECT module, arg_max(path, ordinal) AS path, min(ordinal) AS first FROM m GROUP BY module),
t AS (SELECT path, first, string_split(module, '.') AS parts, unnest(range(2, len(string_split(module, '.')) + 1)) AS k FROM x),
z AS (SELECT array_to_string(parts[k:], '.') AS tail, arg_min(path, first) AS path FROM t GROUP BY tail),
e AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) || '.' WHEN 1 THEN '' ELSE 'other.' END || lower(p_type) || '.' || replace(lower(p_name), ' ', '_') || (p_partkey % 40) AS module, p_partkey % 5 = 0 AS relative FROM part)
SELECT p_partkey, coalesce(x.path, CASE WHEN NOT relative THEN z.path END) AS target_path FROM e LEFT JOIN x ON x.module = e.module LEFT JOIN z ON z.tail = e.module
"""
)
def module_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = "concat(lower(p_type), '.', replace(lower(p_name), ' ', '_'), p_partkey % 40)"
    parts = _read(spark, sf_dir, "part")
    modules = parts.selectExpr(f"concat(lower(p_brand), '.', {tail}) AS module", "concat('m/', p_partkey) AS path", "p_partkey AS ordinal")
    edges = parts.selectExpr("p_partkey", f"concat(CASE p_partkey % 3 WHEN 0 THEN concat(lower(p_brand), '.') WHEN 1 THEN '' ELSE 'other.' END, {tail}) AS module", "p_partkey % 5 = 0 AS relative")
    return I._linked_modules(edges, modules).select("p_partkey", F.col("_to").alias("target_path"))


@_query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return L.numbered(rows, ["user_id", "event_type"], ["ts", "event_id"], "occurrence").select("event_id", "user_id", "event_type", F.col("occurrence").cast("long").alias("occurrence"))


@_query(
    f"""
WITH t AS (SELECT doc_id, 'Project: shop' || chr(10) || 'File: ' || source || '/' || doc_id || chr(10) || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '{X.TRUNCATED.strip()}' ELSE text END AS x FROM documents)
SELECT doc_id, length(x) AS n, sha256(x) AS content_hash FROM t
"""
)
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = X.embedded_text("shop", F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("text"), 400)
    return docs.select("doc_id", text.alias("x")).select("doc_id", F.length("x").cast("long").alias("n"), F.sha2("x", 256).alias("content_hash"))


@_query(
    """
WITH r AS (SELECT p_brand, sha256('{"p_name":"' || p_name || '","p_type":"' || p_type || '","p_size":' || p_size || '}') AS h FROM part)
SELECT p_brand, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM r GROUP BY p_brand
"""
)
def path_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.digests_by_key(_read(spark, sf_dir, "part"), "p_brand", ["p_name", "p_type", "p_size"])


_SUPPLIERS_SQL = """
s AS (SELECT 's' || s_suppkey AS id, s_suppkey % 9 = 0 AS bad, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal / 1000) ELSE 0.0 END AS score FROM supplier),
r AS (SELECT seed, id, bad, row_number() OVER (PARTITION BY seed ORDER BY score DESC, sha256(seed || ':' || id)) AS position FROM range(60) t(seed), s)"""


@_query(
    f"""
WITH {_SUPPLIERS_SQL}, g AS (SELECT seed, min(position) FILTER (bad) AS first, count(*) FILTER (bad) AS found FROM r WHERE position <= 9 GROUP BY seed)
SELECT count(*) AS trials, round(count(first) / count(*)::DOUBLE, 6) AS detection_rate, round(avg(coalesce(first, 9)), 6) AS mean_checks, round(sum(found) / (count(*) * 9)::DOUBLE, 6) AS yield_rate FROM g
"""
)
def schedule_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules over as many scenarios as there are suppliers, ranked by a score that many share."""
    rows, scores = _scenarios(spark, sf_dir)
    return S.replay(S.schedules(spark, rows, 60, 9, scores), rows, 9)


@_query(f"WITH {_SUPPLIERS_SQL} SELECT seed, position, id FROM r WHERE position <= 9")
def schedule_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scores = _scenarios(spark, sf_dir)
    return S.schedules(spark, rows, 60, 9, scores).select("seed", F.col("position").cast("long").alias("position"), "id")


def _scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suppliers = _read(spark, sf_dir, "supplier")
    rows = suppliers.selectExpr("concat('s', s_suppkey) AS id", "concat('p', s_suppkey) AS path", "s_suppkey % 9 = 0 AS introduced_failure")
    return rows, suppliers.where("s_suppkey % 2 = 0").selectExpr("concat('p', s_suppkey) AS path", "round(s_acctbal / 1000) AS score")


# Variants of the graph

_KINDS = ["calls", "imports", "reads_table", "calls_rpc", "invokes_edge_function", "calls_sql"]


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges of all kinds: calls and imports lead to files, the others to resources that several files name."""
    relation = F.get(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % len(_KINDS)).cast("int"))
    named = relation.isin(V.RESOURCE_RELATIONS)
    own = F.col("l_partkey").cast("string")
    return _read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("s/"), "l_suppkey").alias("source_path"),
        F.concat(F.lit("S"), "l_suppkey").alias("source_name"),
        F.lit("").alias("source_qualified_name"),
        relation.alias("relation"),
        F.concat(F.when(named & (F.col("l_partkey") % 7 > 0), "public.").otherwise(""), F.lit("P"), own).alias("target_name"),
        F.when(~named, F.concat(F.lit("p/"), own)).alias("target_path"),
        F.lit(None).cast("string").alias("target_qualified_name"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linestatus") == "O", "same_file").otherwise("active_sql").alias("resolution_confidence"),
    )


_MIXED_SQL = f"""
k AS (SELECT *, [{_TABLE(_KINDS)}][(l_partkey % {len(_KINDS)} + 1)::INT] AS relation FROM lineitem),
e AS (SELECT l_orderkey * 10 + l_linenumber AS id, 's/' || l_suppkey AS s, relation, CASE WHEN relation IN ('calls', 'imports') THEN '' WHEN l_partkey % 7 > 0 THEN 'public.' ELSE '' END || 'P' || l_partkey AS name,
  CASE WHEN relation IN ('calls', 'imports') THEN 'p/' || l_partkey ELSE '' END AS t, l_linenumber AS line, CASE l_linestatus WHEN 'O' THEN 0.9::DOUBLE ELSE 1.0 END AS confidence, l_linestatus <> 'O' AS active_sql,
  CASE relation {" ".join(f"WHEN '{r}' THEN {V.RELATION_WEIGHTS[r]}" for r in _KINDS)} END::DOUBLE AS weight FROM k),
p AS (SELECT *, CASE relation WHEN 'reads_table' THEN 'table' WHEN 'invokes_edge_function' THEN 'edge-function' ELSE 'callable' END AS family,
  CASE WHEN relation IN ('calls', 'imports') THEN false WHEN relation = 'invokes_edge_function' THEN name <> '' ELSE starts_with(name, 'public.') END AS public FROM e)"""


def _variant_sql(variant: str) -> str:
    """The steps of a variant as g: source, target, relation, direction, name, weight, lines."""
    base = "1.0::DOUBLE" if variant == "topology" else "weight / 24.0 * confidence"
    down = "1.0" if variant == "topology" else "0.72"
    factor = lambda path: f"CASE WHEN starts_with({path}, 's/') THEN 0.5 + (substr({path}, 3)::BIGINT % 5) / 10.0::DOUBLE ELSE 0.45 END"
    into_s, into_t = (factor("s"), factor("t")) if variant == "temporal" else ("1.0", "1.0")
    steps = [f"SELECT s AS source, t AS target, relation, 'toward_dependency' AS direction, name, s AS evidence, {base} * {down} * {into_t} AS w, line FROM p WHERE t <> ''", f"SELECT t, s, relation, 'toward_dependent', name, s, {base} * {into_s}, line FROM p WHERE t <> ''"]
    if variant in ("resources", "temporal"):
        node = "'@resource:' || family || ':' || lower(name)"
        steps += [f"SELECT s, {node}, relation, 'toward_resource', name, s, {base} * 0.9, line FROM p WHERE public", f"SELECT {node}, s, relation, 'toward_consumer', name, s, {base} * {into_s}, line FROM p WHERE public"]
    return f"""{_MIXED_SQL}, x AS ({" UNION ALL ".join(steps)}),
g AS (SELECT source, target, relation, direction, name, max(w)::DOUBLE * (1.0 + 0.08 * ln(1 + count(*) - 1)) AS weight, list_sort(list(DISTINCT line)) AS lines FROM x GROUP BY source, target, relation, direction, name, evidence)"""


def _variant(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    factors = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), "s_suppkey").alias("path"), (F.lit(0.5) + (F.col("s_suppkey") % 5) / 10.0).alias("factor"))
    return G.transitions(_mixed(spark, sf_dir), variant, factors if variant == "temporal" else None)


def _weights(steps: DataFrame) -> DataFrame:
    return steps.select("source", "target", "relation", "direction", F.round("weight", 6).alias("weight"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


_WEIGHTS_SQL = "SELECT source, target, relation, direction, round(weight, 6) AS weight, array_to_string(lines, ',') AS lines FROM g"


@_query(f"WITH {_variant_sql('topology')} {_WEIGHTS_SQL}")
def transitions_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_variant(spark, sf_dir, "topology"))


@_query(f"WITH {_variant_sql('resources')} {_WEIGHTS_SQL}")
def transitions_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_variant(spark, sf_dir, "resources"))


@_query(f"WITH {_variant_sql('temporal')} {_WEIGHTS_SQL}")
def transitions_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_variant(spark, sf_dir, "temporal"))


_FOCUS = ["12", "public", "s"]


def _normalised_sql(strict: bool, focus: bool) -> str:
    gate = f"""CASE WHEN source IN ('s/1', 's/2') AND direction IN ('toward_dependency', 'toward_resource')
      THEN CASE WHEN len(list_filter(lines, lambda n: n BETWEEN CASE source WHEN 's/1' THEN 1 ELSE 3 END AND CASE source WHEN 's/1' THEN 2 ELSE 5 END)) > 0 THEN 2.5 ELSE {0.0 if strict else 0.2} END ELSE 1.0 END"""
    words = _PARTS_SQL("name || ' ' || target")
    shared = f"len(list_distinct(list_filter({words}, lambda w: w IN ({_TABLE(_FOCUS)}))))"
    bonus = f"CASE WHEN source IN ('s/1', 's/2', 's/3') THEN 1.0 + least(2.5, 0.75 * {shared}) ELSE 1.0 END" if focus else "1.0"
    return f"""WITH {_variant_sql("resources")}, v AS (SELECT *, weight * ({gate})::DOUBLE * ({bonus})::DOUBLE AS own FROM g), n AS (SELECT *, sum(own) OVER (PARTITION BY source) AS total FROM v)
SELECT source, target, relation, direction, round(own / total, 9) AS probability FROM n WHERE total > 0"""


def _normalised(spark: SparkSession, sf_dir: str, strict: bool, focus: list[str] | None) -> DataFrame:
    seeds = spark.createDataFrame([("s/1",), ("s/2",), ("s/3",)], "path string")
    ranges = spark.createDataFrame([("s/1", 1, 2), ("s/2", 3, 5)], "path string, range_start int, range_end int")
    found = G.normalised(_variant(spark, sf_dir, "resources"), seeds, ranges, focus, strict)
    return found.select("source", "target", "relation", "direction", F.round("probability", 9).alias("probability"))


@_query(_normalised_sql(True, False))
def normalised_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of seeds outside their changed lines count for nothing."""
    return _normalised(spark, sf_dir, True, None)


@_query(_normalised_sql(False, True))
def normalised_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, False, _FOCUS)


# Expansion

_FOLLOWED = lambda n: f"NOT ({n} LIKE 'p/%7')"


@_query(
    """
WITH e AS (SELECT 's/' || l_suppkey AS s, 'p/' || l_partkey AS t, CASE l_returnflag WHEN 'A' THEN 14.0 WHEN 'N' THEN 9.0 ELSE 16.0 END AS w, l_linenumber AS line FROM lineitem),
n AS (SELECT t AS path, 80 + w / 2 AS score FROM e WHERE (s = 's/1' AND (line BETWEEN 1 AND 2 OR line BETWEEN 5 AND 5)) OR s = 's/3' OR (s = 's/4' AND line BETWEEN 3 AND 4)),
a AS (SELECT path, score FROM n WHERE NOT (path LIKE 'p/%7') UNION ALL SELECT s, 80 + w / 2 FROM e WHERE t = 'p/2' UNION ALL SELECT * FROM (VALUES ('s/1', 100.0), ('s/3', 99.0), ('s/4', 98.0), ('p/2', 97.0)))
SELECT path, round(max(score)::DOUBLE, 6) AS score FROM a GROUP BY path
"""
)
def expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a seed outside its changed lines aren't followed; seeds without ranges keep all of theirs."""
    edges = _edges(spark, sf_dir)
    seeds = spark.createDataFrame([("s/1", 0), ("s/3", 1), ("s/4", 2), ("p/2", 3)], "path string, rank int")
    ranges = spark.createDataFrame([("s/1", 1, 2), ("s/1", 5, 5), ("s/4", 3, 4)], "path string, range_start int, range_end int")
    return E.expand(edges, _authority(edges), seeds, 1, "", ranges).scores.select("path", F.round("score", 6).alias("score"))


@_query(
    f"""
WITH {_MIXED_SQL}, q AS (SELECT *, CASE WHEN family = 'edge-function' THEN 'edge_function' ELSE family END AS fam, CASE WHEN relation = 'calls_sql' THEN public AND active_sql ELSE public END AS shared FROM p),
f AS (SELECT DISTINCT fam, name FROM q WHERE s IN ('s/1', 's/2') AND shared),
u AS (SELECT q.fam, q.name, s, row_number() OVER (PARTITION BY q.fam, q.name ORDER BY s, line, id) AS n FROM q JOIN f ON f.fam = q.fam AND f.name = q.name WHERE relation NOT IN ('calls', 'imports')),
c AS (SELECT fam, name, count(*) AS n FROM u WHERE n <= {E.MOST_CONSUMERS} GROUP BY fam, name),
a AS (SELECT t AS path, 80 + weight / 2 AS score FROM q WHERE s IN ('s/1', 's/2') AND t <> '' AND {_FOLLOWED("t")} UNION ALL SELECT 's/1', 100 UNION ALL SELECT 's/2', 99
  UNION ALL SELECT s, 88 - 1.5 * least(30.0, 6.0 * greatest(0.0, log2(c.n / 8.0::DOUBLE))) FROM u JOIN c ON c.fam = u.fam AND c.name = u.name WHERE u.n <= {E.MOST_CONSUMERS})
SELECT path, round(max(score)::DOUBLE, 6) AS score FROM a GROUP BY path
"""
)
def expand_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share a resource with a seed are reached through it."""
    edges = _mixed(spark, sf_dir)
    seeds = spark.createDataFrame([("s/1", 0), ("s/2", 1)], "path string, rank int")
    return E.expand(edges, _authority(edges), seeds, 1).scores.select("path", F.round("score", 6).alias("score"))


# Two states


def _state(spark: SparkSession, sf_dir: str, which: str, active: str) -> T.Snapshot:
    edges = _mixed(spark, sf_dir).where(which)
    rows = edges.select("source_path", F.col("source_name").alias("source_symbol"), "relation", "target_name", F.coalesce("target_path", F.lit("")).alias("target_path"), F.lit("").alias("target_symbol"), "line", F.expr(active).alias("_resolution"), F.lit("{}").alias("_meta"))
    grouped = L.fact_groups(rows, T.EDGE_KEY, "line", {"resolutions": "_resolution", "metadata": "_meta"})
    return T.Snapshot({}, None, None, grouped.select(*T.TABLES["edges"]))


_STATES_SQL = f"""{_MIXED_SQL},
one AS (SELECT s, relation, name, t, any_value(weight) AS weight, any_value(family) AS family, bool_or(public) AS public, list_sort(list(DISTINCT active_sql)) AS r FROM p WHERE id % 10 < 6 GROUP BY s, relation, name, t),
two AS (SELECT s, relation, name, t, any_value(weight) AS weight, any_value(family) AS family, bool_or(public) AS public, list_sort(list(DISTINCT active_sql AND id % 3 > 0)) AS r FROM p WHERE id % 10 > 1 GROUP BY s, relation, name, t),
b AS (SELECT coalesce(one.s, two.s) AS s, coalesce(one.relation, two.relation) AS relation, coalesce(one.name, two.name) AS name, coalesce(one.t, two.t) AS t, coalesce(one.weight, two.weight) AS weight, coalesce(one.family, two.family) AS family, coalesce(one.public, two.public) AS public,
  CASE WHEN two.s IS NULL THEN 'removed' WHEN one.s IS NULL THEN 'added' WHEN one.r <> two.r THEN 'modified' ELSE 'stable' END AS status FROM one FULL JOIN two ON one.s = two.s AND one.relation = two.relation AND one.name = two.name AND one.t = two.t),
w AS (SELECT *, weight / 24.0 * CASE status WHEN 'added' THEN 0.98 WHEN 'stable' THEN 0.72 ELSE 1.0 END AS share, '@resource:' || family || ':' || lower(name) AS node FROM b),
g AS (SELECT s AS source, t AS target, 'toward_dependency' AS direction, relation, status, least(1.0, share * 0.72) AS weight FROM w WHERE t <> '' UNION ALL SELECT t, s, 'toward_dependent', relation, status, least(1.0, share) FROM w WHERE t <> ''
  UNION ALL SELECT s, node, 'toward_resource', relation, status, least(1.0, share * 0.9) FROM w WHERE public UNION ALL SELECT node, s, 'toward_consumer', relation, status, least(1.0, share) FROM w WHERE public)"""


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.union_steps(_state(spark, sf_dir, "id % 10 < 6", "resolution_confidence"), _state(spark, sf_dir, "id % 10 > 1", "CASE WHEN id % 3 > 0 THEN resolution_confidence ELSE 'same_file' END"))


@_query(f"WITH {_STATES_SQL} SELECT source, target, direction, relation, status, round(weight::DOUBLE, 6) AS weight FROM g")
def union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir).select("source", "target", "direction", "relation", "status", F.round("weight", 6).alias("weight"))


@_query(
    f"""
WITH {_STATES_SQL}, h AS (SELECT source, target, max(weight)::DOUBLE AS w FROM g GROUP BY source, target), m0 AS (SELECT 's/1' AS node, 1.0::DOUBLE AS score, 0 AS hops UNION ALL SELECT 's/5', 1.0, 0),
"""
    + ",\n".join(
        f"m{k + 1} AS MATERIALIZED (SELECT node, score, hops FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hops) AS k FROM (SELECT * FROM m0 UNION ALL SELECT target, score * {V.HOP_DECAY} * w, hops + 1 FROM m{k} JOIN h ON source = node)) WHERE k = 1)"
        for k in range(3)
    )
    + "\nSELECT node, round(score, 6) AS score, hops FROM m3"
)
def union_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best product of weights over the edges of both states, three steps from two seeds."""
    labels = G.max_product(_union(spark, sf_dir), spark.createDataFrame([("s/1",), ("s/5",)], "path string"), rounds=3)
    return labels.select("node", F.round("score", 6).alias("score"), "hops")


def _paths_sql(hops: int) -> str:
    """The likeliest way with each number of steps to every node."""
    out = ["c AS (SELECT source, target, max(own / total)::DOUBLE AS p FROM n WHERE own > 0 GROUP BY source, target)", "w0 AS (SELECT 's/1' AS node, 0.0::DOUBLE AS cost, ['s/1'] AS path)"]
    for k in range(hops):
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT node, cost, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, path) AS k FROM (SELECT target AS node, cost - ln(p) AS cost, list_append(path, target) AS path FROM w{k} JOIN c ON source = node WHERE NOT list_contains(path, target))) WHERE k = 1)")
    every = " UNION ALL ".join(f"SELECT * FROM w{k + 1}" for k in range(hops))
    return f"""WITH {_variant_sql("typed")}, n AS (SELECT *, weight AS own, sum(weight) OVER (PARTITION BY source) AS total FROM g), {", ".join(out)},
z AS (SELECT node, cost, len(path) - 1 AS steps, row_number() OVER (PARTITION BY node ORDER BY round(cost, 9), len(path)) AS k FROM ({every}))
SELECT node, round(cost, 6) AS cost, steps FROM z WHERE k = 1"""


@_query(_paths_sql(3))
def strongest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest way of up to three steps to every node that can be reached."""
    steps = G.normalised(_variant(spark, sf_dir, "typed"))
    every = steps.select(F.col("target").alias("path")).distinct()
    found = G.strongest_paths(steps, spark.createDataFrame([("s/1",)], "path string"), every, 3)
    return found.select("node", F.round("cost", 6).alias("cost"), (F.size("path") - 1).cast("long").alias("steps"))
