"""The operators as queries over the driver's tables, each with SQL that gives the same rows.

The tables stand for a repository: documents are files and chunks, parts are symbols, line items are edges from a
supplier's file to a part's, events are versions of definitions, embeddings are vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as C
from .functions import text as X
from .functions import vocabulary as V
from .operators import graph as G
from .operators import ranking as R
from .operators import relational as L
from .operators import schedule as S
from .plans.expand import expand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = ["clown", "trash", "apache license", "anonreti", "tionly", "licensed"]
LETTERS = r"[\p{L}\p{N}_-]+"


def _query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text


@_query(
    """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CASE WHEN raw[len(raw)] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS ls FROM d),
c AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls) - 10) / 7.0))::INT + 1)) * 7 AS o FROM l WHERE len(ls) > 0)
SELECT doc_id, o + 1 AS start_line, o + len(ls[o + 1:o + 10]) AS end_line, array_to_string(ls[o + 1:o + 10], chr(10)) AS content FROM c
"""
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = X.chunk_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 10, 3)
    return chunks.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content")


@_query(
    f"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(strip_accents(lower(text)), '{LETTERS}')) AS token FROM documents)
SELECT lang, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM t GROUP BY lang
"""
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _read(spark, sf_dir, "documents").select("lang", F.explode(X.search_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token").alias("distinct_tokens"))


@_query(
    r"""
WITH n AS (SELECT p_partkey AS key, p_name || ' ' || p_brand || '_' || p_type || 'Camel' || p_name AS x FROM part UNION ALL SELECT page_id, url FROM pages),
t AS (SELECT key, x, regexp_extract_all(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9_-]+') AS parts FROM n)
SELECT key, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(parts, lambda p: regexp_split_to_array(p, '[_-]+'))), lambda q: q <> ''))), ' ') AS tokens FROM t
"""
)
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" "), "p_brand", F.lit("_"), "p_type", F.lit("Camel"), "p_name").alias("x"))
    names = parts.unionByName(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("x")))
    return names.select("key", F.array_join(F.array_sort(X.lexical_tokens(F.col("x"))), " ").alias("tokens"))


#: Path shapes that between them meet every rule.
SHAPES = [
    "docs/history/{}.md",
    "web/src/integrations/supabase/types.ts",
    "db/migrations/{}.sql",
    "tools/AGENTS.md",
    "docs/architecture/{}.md",
    "docs/{}.md",
    "packages/{}/package.json",
    "tsconfig.{}.json",
    "README.md",
    "CHANGELOG.md",
    "notes/{}.rst",
    ".github/workflows/{}.yml",
    "src/tests/{}.py",
    "src/{}.test.ts",
    "src/{}.py",
    "src/history/{}.py",
    "tests.py",
]


@_query(
    "WITH p AS (SELECT doc_id, replace(["
    + ", ".join(f"'{s}'" for s in SHAPES)
    + f"""][(doc_id % {len(SHAPES)} + 1)::INT], '{{}}', doc_id::VARCHAR) AS path FROM documents),
l AS (SELECT doc_id, path, lower(path) AS low, list_last(string_split(lower(path), '/')) AS name FROM p)
SELECT doc_id, path, CASE
  WHEN contains(low, '/history/') OR starts_with(low, 'docs/history/') THEN 'historical'
  WHEN ends_with(low, 'src/integrations/supabase/types.ts') THEN 'generated'
  WHEN starts_with(low, 'migrations/') OR contains(low, '/migrations/') THEN 'schema_history'
  WHEN ends_with(low, 'agents.md') THEN 'canonical'
  WHEN starts_with(low, 'docs/architecture/') OR starts_with(low, 'docs/reference/') THEN 'canonical'
  WHEN starts_with(low, 'docs/') THEN 'active'
  WHEN name IN ('package.json', 'pyproject.toml', 'cargo.toml', 'go.mod', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'makefile') OR starts_with(name, 'tsconfig') OR starts_with(name, 'jest.config') OR starts_with(name, 'vitest.config') OR starts_with(name, 'vite.config') THEN 'config'
  WHEN name IN ('readme.md', 'contributing.md', 'code_of_conduct.md') THEN 'active'
  WHEN name IN ('changelog.md', 'history.md', 'changes.md') THEN 'historical'
  WHEN ends_with(name, '.md') OR ends_with(name, '.rst') OR starts_with(low, '.github/') THEN 'active'
  WHEN len(list_intersect(string_split(low, '/')[1:-2], ['test', 'tests', 'spec', 'specs', '__tests__'])) > 0 OR contains(name, '.test.') OR contains(name, '.spec.') OR contains(name, '_test.') OR contains(name, '_spec.') THEN 'test'
  ELSE 'code' END AS authority FROM l
"""
)
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(*map(F.lit, SHAPES))
    path = F.replace(F.get(shapes, (F.col("doc_id") % len(SHAPES)).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", C.source_class(F.col("path"))["authority"].alias("authority"))


@_query(
    r"""
WITH s AS (SELECT p_partkey, p_name, 'def ' || p_name || '(x):' || chr(10) || '  return ' || p_type AS source FROM part)
SELECT p_partkey, sha256(trim(regexp_replace(regexp_replace(source, '\b' || p_name || '\b', chr(1), 'g'), '\s+', ' ', 'g'))) AS shape FROM s
"""
)
def erased_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("def "), "p_name", F.lit("(x):\n  return "), "p_type")
    return _read(spark, sf_dir, "part").select("p_partkey", X.erased_shape(source, F.col("p_name")).alias("shape"))


# Retrieval


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    docs = _files(spark, sf_dir).join(good, "doc_id", "left")
    return R.bm25(docs, TERMS, {"path": V.PATH_WEIGHT, "content": V.CONTENT_WEIGHT}, keep=F.col("quality") == 1)


def _hits(term: str, tokens: str) -> str:
    words = X.phrase_tokens(term)
    if len(words) == 1:
        return f"len(list_filter({tokens}, lambda x: x = '{words[0]}'))"
    same = " AND ".join(f"{tokens}[k + {i}] = '{w}'" for i, w in enumerate(words))
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda k: {same}))"


_TOKENS_SQL = f"""
f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text FROM documents),
t AS (SELECT doc_id, path, text, regexp_extract_all(strip_accents(lower(path)), '{LETTERS}') AS a, regexp_extract_all(strip_accents(lower(text)), '{LETTERS}') AS b FROM f)"""
_COUNTS_SQL = ", ".join(f"2.5 * {_hits(t, 'a')} + 1.0 * {_hits(t, 'b')} AS f{i}" for i, t in enumerate(TERMS))
_SCORE_SQL = " + ".join(
    f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_d / mean))" for i in range(len(TERMS))
)
_BM25_SQL = f"""{_TOKENS_SQL},
c AS (SELECT doc_id, path, text, len(a) + len(b) AS len_d, {_COUNTS_SQL} FROM t),
s AS (SELECT count(*) AS n, avg(len_d) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(TERMS)))} FROM c),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
bm AS (SELECT doc_id, path, text, ({_SCORE_SQL})::DOUBLE AS score FROM c, s WHERE ({" OR ".join(f"f{i} > 0" for i in range(len(TERMS)))}) AND doc_id IN (SELECT doc_id FROM good))"""


@_query(f"WITH {_BM25_SQL} SELECT doc_id, path, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top(_bm25(spark, sf_dir), 20, F.desc("score"), F.col("doc_id"))
    return best.select("doc_id", "path", F.round("score", 6).alias("score"))


_SINGLE = [t for t in TERMS if " " not in t]
_GROUPS_SQL = " + ".join(
    "greatest(" + ", ".join(f"CASE WHEN list_contains(parts, '{t}') THEN ln((units + 1)::DOUBLE / (d{TERMS.index(t)} + 1)) + 1.0 ELSE 0.0 END" for t in group) + ", 0.0)" for group in X.term_groups(TERMS)
)


@_query(
    f"""
WITH {_BM25_SQL},
u AS (SELECT count(*) AS units, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(TERMS)))} FROM c),
k AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 40),
p AS (SELECT doc_id, score, flatten(list_transform(regexp_extract_all(lower(regexp_replace(path || chr(10) || text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_-]+'), lambda x: regexp_split_to_array(x, '[_-]+'))) AS parts FROM k)
SELECT doc_id, round({_GROUPS_SQL} + score * 0.001, 6) AS specificity FROM p, u
"""
)
def specificity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top(_bm25(spark, sf_dir), 40, F.desc("score"), F.col("doc_id"))
    seen = R.term_frequencies(_files(spark, sf_dir), TERMS, "path", ["path", "content"])
    ranked = R.specificity(best, seen, TERMS, F.concat("path", F.lit("\n"), "content"))
    return ranked.select("doc_id", F.round("specificity", 6).alias("specificity"))


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()[0]  # one vector
    return R.vector_top(vectors, query, k, "vec_id", "embedding")


_DOT_SQL = "list_dot_product(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


@_query(f"SELECT vec_id, round({_DOT_SQL}, 6) AS score FROM embeddings e ORDER BY {_DOT_SQL} DESC, vec_id LIMIT 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 25).select("vec_id", F.round("score", 6).alias("score"))


@_query(
    f"""
WITH {_BM25_SQL},
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 60)),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, {_DOT_SQL} AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 60))
SELECT doc_id, round(sum(part), 6) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM l UNION ALL SELECT doc_id, 0.9::DOUBLE / (60 + rank) FROM v) GROUP BY doc_id
"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    lexical = R.top(_bm25(spark, sf_dir).select("doc_id", "score"), 60, F.desc("score"), F.col("doc_id"))
    semantic = _nearest(spark, sf_dir, 60).withColumnRenamed("vec_id", "doc_id")
    ranked = [x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))) for x in (lexical, semantic)]  # 60 rows each
    return R.fuse([(ranked[0], 1.0), (ranked[1], V.SEMANTIC_WEIGHT)], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@_query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label < 9)")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.missing_vectors(chunks, _read(spark, sf_dir, "embeddings"), "doc_id", "vec_id", F.col("label") < 9)


@_query(
    """
SELECT count(DISTINCT doc_id) AS chunks, count(vec_id) AS embedded_chunks, round(count(vec_id) / count(DISTINCT doc_id)::DOUBLE, 4) AS semantic_coverage,
  greatest(0, count(DISTINCT doc_id) - count(vec_id)) AS pending_chunks FROM documents LEFT JOIN embeddings ON vec_id = doc_id
"""
)
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coverage(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples are sources: ranked by document length, gold the documents of quality 1.

    The metrics need the first five of a source and the rank of its first gold document, which is one more than the
    documents before it: counts that combine before the shuffle, as a source may hold a third of all rows.
    """
    from pyspark.sql import Window as W

    docs = _read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    gold = docs.join(good.withColumn("_g", F.lit(True)), "doc_id", "left")
    place = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
    first = gold.where("_g").groupBy("source").agg(F.min(place).alias("_first"))
    before = docs.join(first, "source").groupBy("source", "_first").agg((F.count_if(place < F.col("_first")) + 1).alias("rank")).select("source", F.col("_first.doc_id").alias("doc_id"), "rank")
    top = docs.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")).where("rank <= 5")
    return top.select("source", "doc_id", "rank").unionByName(before.where("rank > 5")), gold.select("source", F.when(F.col("_g"), F.col("doc_id")).alias("doc_id"))


_METRICS_SQL = """
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
g AS (SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN doc_id END AS doc_id FROM documents),
m AS (SELECT g.source, count(g.doc_id) AS n_gold, count(*) FILTER (rank <= 5) AS found, min(rank) AS first FROM g LEFT JOIN r ON r.source = g.source AND r.doc_id = g.doc_id GROUP BY g.source),
x AS (SELECT source, n_gold, found, CASE WHEN n_gold = 0 THEN 1.0 ELSE found / n_gold::DOUBLE END::DOUBLE AS recall, coalesce(1.0::DOUBLE / first, 0.0) AS reciprocal_rank, found = n_gold AS all_found FROM m)"""


@_query(f"WITH {_METRICS_SQL} SELECT source, n_gold, found, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, all_found FROM x")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, gold = _samples(spark, sf_dir)
    found = R.retrieval_metrics(ranked, gold, "source", "doc_id", 5)
    return found.withColumns({"recall": F.round("recall", 6), "reciprocal_rank": F.round("reciprocal_rank", 6)})


@_query(
    f"""
WITH {_METRICS_SQL}, s AS (SELECT 'all' AS stratum, * FROM x UNION ALL SELECT 'lexical_miss', * FROM x WHERE found = 0 UNION ALL SELECT 'many', * FROM x WHERE n_gold >= 5)
SELECT stratum, count(*) AS samples, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM s GROUP BY stratum
"""
)
def strata_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, gold = _samples(spark, sf_dir)
    found = R.retrieval_metrics(ranked, gold, "source", "doc_id", 5).withColumn("lexical_miss", F.col("found") == 0).withColumn("many", F.col("n_gold") >= 5)
    out = R.strata(found, ["lexical_miss", "many"], ["recall", "reciprocal_rank"])
    return out.withColumns({"recall": F.round("recall", 6), "reciprocal_rank": F.round("reciprocal_rank", 6)})


# Symbols


@_query("SELECT event_id, user_id, event_type, (row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts DESC, event_id DESC) = 1)::INT AS active FROM events")
def latest_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return L.mark_latest(rows, F.struct("user_id", F.lower("event_type")), ["ts", "event_id"]).select("event_id", "user_id", "event_type", "active")


@_query(
    """
WITH d AS (SELECT p_partkey, p_brand, p_type, p_name || (p_partkey % 300)::VARCHAR AS n FROM part),
k AS (SELECT DISTINCT p_partkey, p_brand, p_type, unnest([lower(n), list_last(string_split(lower(n), ' '))]) AS key FROM d),
t AS (SELECT key, min(p_brand) AS path, arg_max(p_type, p_partkey) AS value FROM k GROUP BY key HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, coalesce(path, CASE WHEN p_partkey % 5 = 0 THEN p_brand END) AS target_path, value AS target, CASE WHEN path IS NULL THEN 'lexical' ELSE 'active_sql' END AS resolution
FROM d LEFT JOIN t ON p_partkey % 5 <> 0 AND key = list_last(string_split(lower(n), ' '))
"""
)
def unique_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _read(spark, sf_dir, "part").withColumn("n", F.concat("p_name", (F.col("p_partkey") % 300).cast("string")))
    last = F.element_at(F.split(F.lower("n"), " "), -1)
    targets = L.unique_targets(named, [F.lower("n"), last], "p_brand", "p_type", "p_partkey")
    known = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand"))
    edges = named.select("p_partkey", "n", known.alias("target_path"), F.lit(None).cast("string").alias("target"), F.lit("lexical").alias("resolution"))
    return L.link_targets(edges, targets, last, F.col("target_path").isNull(), "target_path", "target", "resolution", "active_sql").drop("n")


@_query(
    """
SELECT p_partkey, p_name, p_brand, CASE WHEN lower(p_name) = 'red bolt' THEN 0 WHEN lower(p_brand) = 'red bolt' THEN 1 WHEN lower(p_name) LIKE 'red bolt%' THEN 2 ELSE 3 END AS rank FROM part
WHERE lower(p_name) LIKE '%red%bolt%' OR lower(p_brand) LIKE '%red%bolt%' ORDER BY rank, p_size DESC, p_brand, p_partkey LIMIT 30
"""
)
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").where(X.like_anywhere(F.col("p_name"), "red%bolt") | X.like_anywhere(F.col("p_brand"), "red%bolt"))
    name = F.lower("p_name")
    rank = F.when(name == "red bolt", 0).when(F.lower("p_brand") == "red bolt", 1).when(X.like_anywhere(F.col("p_name"), "red bolt", prefix=True), 2).otherwise(3)
    return parts.withColumn("rank", rank).orderBy("rank", F.desc("p_size"), "p_brand", "p_partkey").limit(30).select("p_partkey", "p_name", "p_brand", "rank")


@_query()
def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return R.fuzzy(parts, "rde bloot", ["p_name", "p_brand"], order=["p_brand", "p_partkey"])


@_query(
    """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CASE WHEN raw[len(raw)] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS ls FROM d),
c AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls) - 10) / 7.0))::INT + 1)) * 7 AS o FROM l WHERE len(ls) > 0),
s AS (SELECT doc_id, o + 1 AS start_line, o + len(ls[o + 1:o + 10]) AS end_line FROM c),
r AS (SELECT doc_id, 1 + doc_id % 17 AS range_start, 1 + doc_id % 17 + doc_id % 3 AS range_end FROM documents UNION ALL SELECT doc_id, 40, 45 FROM documents)
SELECT doc_id, start_line, end_line FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND start_line <= range_end AND end_line >= range_start)
"""
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = X.chunk_lines(docs, "text", 10, 3).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")))
    start = 1 + F.col("doc_id") % 17
    ranges = docs.select("doc_id", start.alias("range_start"), (start + F.col("doc_id") % 3).alias("range_end")).unionByName(docs.select("doc_id", F.lit(40).cast("long").alias("range_start"), F.lit(45).cast("long").alias("range_end")))
    return L.overlapping(chunks, ranges, "doc_id", "start_line", "end_line")


@_query(
    """
SELECT e.p_partkey, e.p_type, x.p_partkey AS existing_key, x.p_brand AS existing_brand FROM part e, LATERAL (
  SELECT p_partkey, p_brand FROM part WHERE lower(p_type) = lower(e.p_type) AND p_brand <> e.p_brand ORDER BY p_brand, p_partkey LIMIT 12) x
"""
)
def same_name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    found = L.same_name(parts, parts, "p_type", "p_brand", ["p_brand", "p_partkey"])
    return found.select("p_partkey", "p_type", F.col("existing_p_partkey").alias("existing_key"), F.col("existing_p_brand").alias("existing_brand"))


# Edges


@_query(
    """
SELECT l_suppkey, l_returnflag, l_partkey, count(DISTINCT l_linenumber) AS occurrences, min(l_linenumber) AS first_line,
  array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS resolutions
FROM lineitem GROUP BY l_suppkey, l_returnflag, l_partkey
"""
)
def edge_fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_suppkey", "l_returnflag", "l_partkey"]
    grouped = L.fact_groups(_read(spark, sf_dir, "lineitem"), keys, "l_linenumber", {"resolutions": "l_linestatus"})
    return grouped.select(*keys, "occurrences", "first_line", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("resolutions", ",").alias("resolutions"))


@_query(
    """
WITH f AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS k FROM lineitem),
c AS (SELECT l_partkey, count(*) AS n FROM f WHERE k <= 20 GROUP BY l_partkey)
SELECT DISTINCT f.l_partkey, l_suppkey, n AS consumer_count, round(least(30.0, 6.0 * greatest(0.0, log2(greatest(1, n) / 8.0::DOUBLE))), 6) AS penalty FROM f JOIN c ON c.l_partkey = f.l_partkey WHERE k <= 20
"""
)
def shared_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.shared_consumers(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", ["l_suppkey", "l_orderkey", "l_linenumber"], 20)
    return found.withColumn("penalty", F.round("penalty", 6))


def _relations() -> str:
    return "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'extends' END"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges between files of suppliers and parts."""
    rows = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "concat('s/', l_suppkey) AS source_path",
        "concat('S', l_suppkey) AS source_name",
        "concat('S', l_suppkey) AS source_qualified_name",
        f"{_relations()} AS relation",
        "concat('P', l_partkey) AS target_name",
        "concat('p/', l_partkey) AS target_path",
        "concat('P', l_partkey) AS target_qualified_name",
        "l_linenumber AS line",
        "CASE l_linestatus WHEN 'O' THEN 'same_file' ELSE 'import_resolved' END AS resolution_confidence",
    )
    return rows


_EDGES_SQL = f"""
e AS (SELECT 's/' || l_suppkey AS s, 'p/' || l_partkey AS t, 'P' || l_partkey AS name, {_relations()} AS relation, l_linenumber AS line,
  CASE l_linestatus WHEN 'O' THEN 0.9 ELSE 0.95 END AS confidence FROM lineitem)"""
_WEIGHT_SQL = "CASE relation WHEN 'calls' THEN 14.0 WHEN 'imports' THEN 9.0 ELSE 16.0 END"


def _authority(edges: DataFrame) -> DataFrame:
    paths = edges.select(F.explode(F.array("source_path", "target_path")).alias("path")).distinct()
    return paths.withColumn("authority", F.when(F.col("path").startswith("p/") & F.col("path").endswith("7"), "historical").otherwise("code"))


def _expanded(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = spark.createDataFrame([("s/1", 0), ("p/2", 1), ("s/3", 2)], "path string, rank int")
    return expand(edges, _authority(edges), seeds, depth).scores.select("path", F.round("score", 6).alias("score"))


def _expand_sql(depth: int) -> str:
    follow = lambda frontier, level: f"""SELECT n AS path, relation, {80 if level == 0 else 62} + {_WEIGHT_SQL} / {2 * (level + 1)} AS score FROM (
      SELECT t AS n, relation FROM e WHERE s IN (SELECT path FROM {frontier}) UNION ALL SELECT s, relation FROM e WHERE t IN (SELECT path FROM {frontier}))
      WHERE NOT (n LIKE 'p/%7')"""  # noqa: E731
    levels = [f"l{k} AS ({follow('seeds' if k == 0 else f'f{k}', k)})" + (f", f{k + 1} AS (SELECT DISTINCT path FROM l{k} WHERE relation <> 'imports')" if k + 1 < depth else "") for k in range(depth)]
    union = " UNION ALL ".join(["SELECT path, 100.0 - rank AS score FROM seeds", *(f"SELECT path, score FROM l{k}" for k in range(depth))])
    return f"WITH {_EDGES_SQL}, seeds AS (SELECT * FROM (VALUES ('s/1', 0), ('p/2', 1), ('s/3', 2)) v(path, rank)), {', '.join(levels)} SELECT path, round(max(score)::DOUBLE, 6) AS score FROM ({union}) GROUP BY path"


@_query(_expand_sql(1))
def expand_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 1)


@_query(_expand_sql(2))
def expand_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 2)


@_query(
    f"""
WITH {_EDGES_SQL}, f AS (SELECT s, t, {_WEIGHT_SQL} AS w FROM e WHERE t IN ('p/1', 'p/2', 'p/3') OR s IN ('s/1', 's/2')),
x AS (SELECT s AS path, w FROM f UNION ALL SELECT t, w FROM f)
SELECT path, sum(w)::DOUBLE AS score FROM x WHERE path NOT IN ('s/1', 's/2') GROUP BY path
"""
)
def ripple_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _edges(spark, sf_dir).where(F.col("target_path").isin("p/1", "p/2", "p/3") | F.col("source_path").isin("s/1", "s/2"))
    changed = spark.createDataFrame([("s/1",), ("s/2",)], "path string")
    return G.ripple_scores(facts, "source_path", "target_path", "relation", changed, "path")


_STEPS_SQL = f"""{_EDGES_SQL},
x AS (SELECT s AS source, t AS target, relation, 'toward_dependency' AS direction, name, s AS evidence, {_WEIGHT_SQL} / 24.0 * confidence * 0.72 AS w, line FROM e
  UNION ALL SELECT t, s, relation, 'toward_dependent', name, s, {_WEIGHT_SQL} / 24.0 * confidence, line FROM e),
g AS (SELECT source, target, relation, direction, name, max(w)::DOUBLE * (1.0 + 0.08 * ln(1 + count(*) - 1)) AS weight FROM x GROUP BY source, target, relation, direction, name, evidence),
n AS (SELECT *, weight / sum(weight) OVER (PARTITION BY source) AS probability FROM g)"""


@_query(f"WITH {_STEPS_SQL} SELECT source, target, relation, direction, round(weight, 6) AS weight FROM g")
def transition_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transitions(_edges(spark, sf_dir), "typed").select("source", "target", "relation", "direction", F.round("weight", 6).alias("weight"))


@_query(f"WITH {_STEPS_SQL} SELECT source, target, relation, direction, round(probability, 9) AS probability FROM n")
def row_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalised(G.transitions(_edges(spark, sf_dir), "typed")).select("source", "target", "relation", "direction", F.round("probability", 9).alias("probability"))


@_query(
    f"""
WITH {_EDGES_SQL}, syms AS (SELECT p_partkey, p_brand AS path, p_type = 'ECONOMY' AS is_table, p_size, p_partkey % 3 AS active FROM part),
a AS (SELECT path, count(*) FILTER (NOT is_table) AS total, sum(CASE WHEN NOT is_table THEN active % 2 ELSE 0 END) AS active, max(is_table::INT) AS has_table FROM syms GROUP BY path)
SELECT path, round(CASE WHEN path LIKE '%2' THEN 1.0 WHEN total = 0 THEN 0.8 ELSE greatest(CASE WHEN has_table = 1 THEN 0.8 ELSE 0.12 END, active / total::DOUBLE) END::DOUBLE, 6) AS activity FROM a
"""
)
def temporal_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    symbols = parts.select(F.col("p_brand").alias("path"), F.when(F.col("p_type") == "ECONOMY", "table").otherwise("function").alias("kind"), ((F.col("p_partkey") % 3) % 2).cast("int").alias("active"))
    authority = parts.select(F.col("p_brand").alias("path")).distinct().withColumn("authority", F.when(F.col("path").endswith("2"), "code").otherwise("schema_history"))
    return G.temporal_activity(symbols, authority).withColumn("activity", F.round("activity", 6))


def _rank_sql(rounds: int) -> str:
    out = [f"p AS (SELECT source, target, sum(probability) AS probability FROM n GROUP BY source, target), s0 AS (SELECT * FROM (VALUES ('s/1', 0.5::DOUBLE), ('p/2', 0.5::DOUBLE)) v(node, mass))"]
    for k in range(rounds):
        out.append(
            f"""s{k + 1} AS MATERIALIZED (SELECT node, sum(mass) AS mass FROM (SELECT target AS node, mass * probability * 0.72 AS mass FROM s{k} JOIN p ON source = node
            UNION ALL SELECT node, mass * (0.28 + 0.72 * (SELECT coalesce(sum(mass), 0) FROM s{k} WHERE node NOT IN (SELECT source FROM p))) FROM s0) GROUP BY node)"""
        )
    return f"WITH {_STEPS_SQL}, {', '.join(out)} SELECT node, round(mass, 6) AS mass FROM s{rounds}"


@_query(_rank_sql(4))
def ppr_k_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("s/1",), ("p/2",)], "path string")
    state = G.page_rank(G.normalised(G.transitions(_edges(spark, sf_dir), "typed")), seeds, rounds=4, fixed=True)
    return state.select("node", F.round("mass", 6).alias("mass"))


def _product_sql(rounds: int) -> str:
    out = [f"b AS (SELECT source, target, max(w)::DOUBLE AS w FROM (SELECT s AS source, t AS target, {_WEIGHT_SQL} / 24.0 * 0.72 * 0.72 AS w FROM e UNION ALL SELECT t, s, {_WEIGHT_SQL} / 24.0 * 0.72 FROM e) GROUP BY source, target)", "m0 AS (SELECT 's/1' AS node, 1.0::DOUBLE AS score, 0 AS hops)"]
    for k in range(rounds):
        out.append(
            f"""m{k + 1} AS (SELECT node, score, hops FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hops) AS k FROM (
            SELECT * FROM m0 UNION ALL SELECT target, score * 0.78 * w, hops + 1 FROM m{k} JOIN b ON source = node WHERE hops < 4)) WHERE k = 1)"""
        )
    return f"WITH {_EDGES_SQL}, {', '.join(out)} SELECT node, round(score, 6) AS score, hops FROM m{rounds}"


@_query(_rank_sql(12))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve rounds, cut after the sixth: as many as the SQL spells out."""
    seeds = spark.createDataFrame([("s/1",), ("p/2",)], "path string")
    state = G.page_rank(G.normalised(G.transitions(_edges(spark, sf_dir), "typed")), seeds, rounds=12, tolerance=0.0, every=6)
    return state.select("node", F.round("mass", 6).alias("mass"))


@_query(_product_sql(3))
def union_maxprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).withColumn("_w", G.relation_weight(F.col("relation")) / 24.0 * V.STATUS_WEIGHTS["stable"])
    down = edges.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), (F.col("_w") * V.DIRECTION_WEIGHTS["toward_dependency"]).alias("weight"))
    up = edges.select(F.col("target_path").alias("source"), F.col("source_path").alias("target"), F.col("_w").alias("weight"))
    labels = G.max_product(down.unionByName(up), spark.createDataFrame([("s/1",)], "path string"), rounds=3)
    return labels.select("node", F.round("score", 6).alias("score"), "hops")


@_query(
    """
WITH RECURSIVE l AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
w AS (SELECT 'c0' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN d ON a = node WHERE hops < 4)
SELECT node, min(hops) AS hops FROM w GROUP BY node
"""
)
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(name: str, a: str, b: str) -> DataFrame:
        return _read(spark, sf_dir, name).selectExpr(f"{a} AS source", f"{b} AS target")

    links = link("customer", "concat('c', c_custkey)", "concat('n', c_nationkey)")
    links = links.unionByName(link("supplier", "concat('s', s_suppkey)", "concat('n', s_nationkey)")).unionByName(link("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return G.hop_distances(both, spark.createDataFrame([("c0",)], "path string"), 4)


# Snapshots


@_query(
    """
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 10 <> 1),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.price AS p0, b.price AS p1, a.p AS q0, b.p AS q1, a.o_orderkey IS NULL AS new, b.o_orderkey IS NULL AS gone
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey)
SELECT o_orderkey, o_custkey, CASE WHEN gone THEN 'removed' WHEN new THEN 'added' WHEN p0 <> p1 THEN 'modified' ELSE 'relocated' END AS change, CASE WHEN gone THEN -1 WHEN new THEN 1 ELSE 0 END AS sign,
  CASE WHEN gone OR new THEN '' ELSE array_to_string(list_filter([CASE WHEN p0 <> p1 THEN 'price' END, CASE WHEN q0 <> q1 THEN 'priority' END], lambda x: x IS NOT NULL), ',') END AS changed_fields
FROM j WHERE gone OR new OR p0 <> p1 OR q0 <> q1
"""
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    before, after = orders.where("o_orderkey % 10 <> 0"), orders.where("o_orderkey % 10 <> 1")
    after = after.withColumns({"price": F.when(F.col("o_orderkey") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")), "priority": F.when(F.col("o_orderkey") % 11 == 0, "moved").otherwise(F.col("priority"))})
    found = L.snapshot_delta(before, after, ["o_orderkey", "o_custkey"], ["price"], ["priority"])
    return found.select("o_orderkey", "o_custkey", "change", "sign", F.array_join("changed_fields", ",").alias("changed_fields"))


@_query(
    """
WITH a AS (SELECT c_mktsegment AS kind, round(c_acctbal / 20)::BIGINT AS shape, c_nationkey AS path, c_name AS name FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_mktsegment AS kind, round(c_acctbal / 20)::BIGINT AS shape, c_nationkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'same' ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 1),
x AS (SELECT kind, shape, any_value(path) AS path, any_value(name) AS name FROM a GROUP BY kind, shape HAVING count(*) = 1), y AS (SELECT kind, shape, any_value(path) AS path, any_value(name) AS name FROM b GROUP BY kind, shape HAVING count(*) = 1)
SELECT kind, shape, x.path AS before_path, x.name AS before_name, y.path AS after_path, y.name AS after_name,
  CASE WHEN x.path = y.path AND x.name <> y.name THEN 'rename_candidate' WHEN x.path <> y.path AND x.name = y.name THEN 'move_candidate' ELSE 'identity_replacement_candidate' END AS change FROM x JOIN y USING (kind, shape)
"""
)
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.round(F.col("c_acctbal") / 20).cast("long").alias("shape"), F.col("c_nationkey").alias("path"), F.col("c_name").alias("name"))
    removed, added = rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1").withColumn("name", F.when(F.col("c_custkey") % 3 == 0, "same").otherwise(F.col("name")))
    return L.rename_candidates(removed.drop("c_custkey"), added.drop("c_custkey"), ["kind", "shape"], "path", "name")


@_query(
    """
WITH a AS (SELECT doc_id, lang, n_chars // 100 AS size, row_number() OVER (PARTITION BY lang, n_chars // 100 ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT lang, n_chars // 100 AS size, row_number() OVER (PARTITION BY lang, n_chars // 100) AS k FROM documents WHERE doc_id % 3 <> 1)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.size, b.size) AS size, doc_id, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'keep' END AS action
FROM a FULL JOIN b ON a.lang = b.lang AND a.size = b.size AND a.k = b.k
"""
)
def multiset_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "n_chars div 100 AS size")
    return L.publish_chunks(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 <> 1"), ["lang", "size"], "doc_id")


# Schedules

# The six checks whose replay by chance is published as 0.351 detected, 1.82 checks and 0.1755 yield (2000 trials, budget 2).
SCENARIOS = [
    ("accounts-rounding", "test/accounts.test.js", False),
    ("documents-title", "test/documents.test.js", False),
    ("inventory-floor", "test/inventory.test.js", False),
    ("payroll-hours", "test/payroll.test.js", False),
    ("planner-normalization", "test/planner.test.js", True),
    ("reports-label", "test/reports.test.js", False),
]


@_query(
    "WITH s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{i}', {'true' if f else 'false'})" for i, _, f in SCENARIOS)
    + """) v(id, bad)),
r AS (SELECT seed, id, bad, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || id)) AS position FROM range(2000) t(seed), s),
g AS (SELECT seed, min(position) FILTER (bad) AS first, count(*) FILTER (bad) AS found FROM r WHERE position <= 2 GROUP BY seed)
SELECT count(*) AS trials, round(count(first) / count(*)::DOUBLE, 6) AS detection_rate, round(avg(coalesce(first, 2)), 6) AS mean_checks, round(sum(found) / (count(*) * 2)::DOUBLE, 6) AS yield_rate FROM g
"""
)
def schedule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SCENARIOS, "id string, path string, introduced_failure boolean")
    return S.replay(S.schedules(spark, rows, 2000, 2), rows, 2)


@_query(
    "WITH s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{i}')" for i, _, _ in SCENARIOS)
    + ") v(id)), r AS (SELECT id, row_number() OVER (PARTITION BY seed ORDER BY (id IN ('planner-normalization', 'payroll-hours')) DESC, sha256(seed || ':' || id)) AS k FROM range(500) t(seed), s) SELECT id, count(*) FILTER (k <= 3) AS selected FROM r GROUP BY id"
)
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SCENARIOS, "id string, path string, introduced_failure boolean")
    scores = spark.createDataFrame([("test/planner.test.js", 0.5), ("test/payroll.test.js", 0.5)], "path string, score double")
    return S.selection_counts(S.schedules(spark, rows, 500, 3, scores), rows)
