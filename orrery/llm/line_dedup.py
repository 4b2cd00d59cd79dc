"""Line dedup by winnowing, with DataFrame functions only.

A document is the sequence of its lines' hashes. In every window of ``least_lines`` lines the smallest hash (the last of
equals) is the fingerprint; a line of ``least_chars`` characters is one by itself, and so is every shorter window that has so
many. A fingerprint's line alone doesn't tell which earlier place holds the same run: the earliest place of the line may
have other lines around it. So positions are joined by the fingerprint together with the rest of its window, and every
window meets its own first copy. The match is extended both ways from the fingerprint, over the window and on over
blank lines; matches that touch are one run, and the later run goes. The first of equal lines always stays.

What goes: every line of a run of lines, not all blank, that an earlier place holds, too, if the run has ``least_lines``
lines or ``least_chars`` characters outside blank lines. The work grows with the number of lines, repeated or not.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, whole_row

#: A run goes if it has so many lines or so many characters.
LEAST_LINES, LEAST_CHARS = 2, 40
#: Windows with more than this share (1 in so many) of all repeated ones are so few that their first places are broadcast.
HOT_SHARE = 1000
#: Blank lines hash to the largest value: they're fingerprints only of blank windows, which are left out.
_BLANK = "unhex('ffffffffffffffffffffffffffffffff')"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(F.trim(x) == "", F.expr(_BLANK)).otherwise(F.unhex(F.md5(x))))


def _key(id_col: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text)))


def _print(place: Column, before: Column, after: Column, content: Column) -> Column:
    """A fingerprint at ``place``, whose match reaches so many lines back and on."""
    return F.struct(place.cast("int").alias("_p"), before.cast("int").alias("_before"), after.cast("int").alias("_after"), F.unhex(F.md5(content)).alias("_hash"))


def _fingerprints(hashes: Column, chars: Column, solid: Column, least_lines: int, least_chars: int) -> Column:
    """(_p, _before, _after, _hash) of the fingerprint of every window: the hash is that of the window's lines. ``solid`` holds the places of the lines that aren't blank.

    Blank lines further than a window from another line go with a run from there up to them: one
    fingerprint each way, for the blank line alone, as shorter runs have the rest.
    """
    blank = F.expr(_BLANK)

    def window(n: int):
        def at(h: Column, p: Column) -> Column:
            part = [h, *(F.get(hashes, p + k) for k in range(1, n))]
            some = functools.reduce(Column.__or__, (x != blank for x in part))
            if n < least_lines:
                long = sum((F.when(x != blank, F.get(chars, p + k)).otherwise(0) for k, x in enumerate(part)), F.lit(0))
                some = some & (long >= least_chars)
            least = F.least(*part) if n > 1 else h
            place = F.coalesce(*(F.when(x == least, k) for k, x in reversed(list(enumerate(part)))))
            return _print(p + place, place, n - 1 - place, F.when(some, F.concat(*part)))

        return at

    def stretches(p: Column, k: Column) -> Column:
        after = F.coalesce(F.get(solid, k + 1), F.size(hashes)) - p - 1
        before = p - F.coalesce(F.get(solid, k - 1), F.lit(-1)) - 1

        def up_to(n: Column, way: int) -> Column:
            places = F.when(n >= least_lines, F.sequence(F.lit(least_lines), n)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda j: _print(p + way * j, F.lit(0), F.lit(0), F.concat(F.get(hashes, p), F.encode((way * j).cast("string"), "utf-8"))))

        return F.concat(up_to(after, 1), up_to(before, -1))

    found = F.concat(*(F.transform(hashes, window(n)) for n in range(1, least_lines + 1)), F.flatten(F.transform(solid, stretches)))
    return F.filter(found, lambda x: x["_hash"].isNotNull())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_key (of id and text) and _gone, the ascending places of the lines that go, for documents with any.

    A window that very many places hold (a license line) is one row per task before its first place is known. The few
    such windows are then broadcast (fewer than ``HOT_SHARE``, since each has more than one in so many of all repeats), and their places dealt out by document, not by window.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_col).alias("_id"), _key(F.col(id_col), text).alias("_key"), _lines(text).alias("_lines"))
    solid = F.filter(F.transform("_lines", lambda x, p: F.when(F.trim(x) != "", p)), lambda p: p.isNotNull())
    # Columns of a checkpoint, not expressions: lambdas would work an expression out again for every line.
    base = cut(lines.select("_id", "_key", _hashes(F.col("_lines")).alias("_hashes"), F.transform("_lines", F.length).alias("_chars"), solid.alias("_solid")))
    prints = base.select("_id", "_key", F.inline(_fingerprints(F.col("_hashes"), F.col("_chars"), F.col("_solid"), least_lines, least_chars)))
    found = prints.groupBy("_hash").agg(F.min(F.struct("_id", "_key", "_p")).alias("_first"), F.count(F.lit(1)).alias("_count")).where("_count > 1")
    first = cut(found.select("_hash", F.struct(F.col("_first._key").alias("key"), F.col("_first._p").alias("p")).alias("_from"), "_count"))
    least = (first.agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0]) // HOT_SHARE
    hot = first.where(F.col("_count") > least + 1).select("_hash", F.col("_from").alias("_hot"))
    cold = first.where(F.col("_count") <= least + 1).select("_hash", F.lit(0).alias("_salt"), "_from")
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.hash("_key", "_p"), F.lit(HOT_SHARE)) + 1)
    met = prints.join(F.broadcast(hot), "_hash", "left").withColumn("_salt", spread).join(cold, ["_hash", "_salt"], "left").withColumn("_from", F.coalesce("_hot", "_from"))
    later = met.where("_from IS NOT NULL AND NOT (_key = _from.key AND _p = _from.p)")
    runs = later.groupBy("_key").agg(F.collect_list(F.sequence(F.col("_p") - F.col("_before"), F.col("_p") + F.col("_after"))).alias("_runs"))
    return runs.select("_key", F.sort_array(F.array_distinct(F.flatten("_runs"))).alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and the columns n_lines and removed_lines (ascending places, from 0).

    Lines end at a line feed; blank lines (empty, or spaces alone) go only within a longer run. Earlier means a smaller id
    (null first), then a smaller place. Null text stays null and counts as one empty line. Rows that repeat an id are
    documents of their own if their texts differ, else one document whose rows get the same result. Columns named n_lines
    or removed_lines are replaced; all others stay, whatever their names. Very long texts cost in proportion. An empty
    table gives no rows.
    """
    rest = [k for k in docs.columns if k not in ("n_lines", "removed_lines")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(whole_row(rest), _key(F.col(id_col), text).alias("_key"))
    found = rows.join(repeated_runs(docs, id_col, text_col, **how), "_key", "left").select("_row", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    lines = _lines(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")))
    found = found.select("_row", "_gone", lines.alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(stay, lambda k: F.get(F.col("_lines"), k)), "\n")
    out = [F.when(F.size("_gone") > 0, left).otherwise(F.col("_row")[k]).alias(k) if k == text_col else F.col("_row")[k].alias(k) for k in rest]
    return found.select(*out, F.size("_lines").cast("long").alias("n_lines"), F.col("_gone").alias("removed_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (places, comma-joined), clean_sha256. Null and empty texts count as one line; an empty table gives no rows."""
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


#: From the statement: the shortest runs that make lines go are two lines, one long line, and a line with the blank lines up to one beside it.
ORACLE = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, k - 1 AS p, ls[k] AS x, CASE WHEN trim(ls[k]) = '' THEN '' ELSE md5(ls[k]) END AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM docs)),
around AS (SELECT *, lead(h) OVER line AS next_h, max(CASE WHEN h <> '' THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS text_before,
    min(CASE WHEN h <> '' THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS text_after
  FROM ln WINDOW line AS (PARTITION BY doc_id ORDER BY p)),
runs AS (
  SELECT doc_id, p AS lo, p + 1 AS hi, h || '/' || next_h AS what FROM around WHERE next_h IS NOT NULL AND h || next_h <> ''
  UNION ALL SELECT doc_id, p, p, h FROM around WHERE h <> '' AND length(x) >= {LEAST_CHARS}
  UNION ALL SELECT b.doc_id, s.p, b.p, s.h || '+' || (b.p - s.p) FROM around b JOIN ln s ON s.doc_id = b.doc_id AND s.p = b.text_before WHERE b.h = ''
  UNION ALL SELECT b.doc_id, b.p, s.p, (s.p - b.p) || '+' || s.h FROM around b JOIN ln s ON s.doc_id = b.doc_id AND s.p = b.text_after WHERE b.h = ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY doc_id, lo) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS p FROM placed WHERE k > 1)
SELECT ln.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed, coalesce(string_agg(gone.p::VARCHAR, ',' ORDER BY ln.p), '') AS removed,
  sha256(coalesce(string_agg(CASE WHEN gone.p IS NULL THEN ln.x END, chr(10) ORDER BY ln.p), '')) AS clean_sha256
FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.p = ln.p GROUP BY ln.doc_id
"""
