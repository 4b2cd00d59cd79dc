"""Personal data, with DataFrame functions only.

Regular expressions propose spans; validators (Luhn, mod-97, number ranges, digit counts) confirm them; words near a
span adjust its score. Spark gives matches without their places, so a text is also split by the same pattern: a match
starts after all gaps and matches before it. The patterns use possessive quantifiers and may start a match only at
the start of a run or where the last match ended, so that long runs cost linear time and no stack; what they match is
what the plain patterns below match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Kinds in the order in which spans with one start are listed.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

# The plain patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]{4}){2,7}([\x20]?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

#: The same matches in linear time.
LINEAR_PATTERNS = PATTERNS | {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}

#: What a text must hold for its kind to be looked for.
HINTS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}

# Words that raise a score when they stand near, and the score that a confirmed span starts from.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|server|host|address|login",
    "card": "card|visa|mastercard|amex|payment|credit|debit",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, LEAST_SCORE = 0.2, 40, 0.5

_BYTE = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum that 10 divides."""
    n = F.length(digits)

    def place(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, k: total + place(k)) % 10 == 0


def _mod97(account: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.replace(found, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), _mod97(account)).otherwise(False)
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The kind's confirmed spans that score enough, by start."""
    gaps = F.slice(F.split(text, LINEAR_PATTERNS[kind], -1), F.lit(1), F.size(matches))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, stop: INT, found: STRING>>)")
    # Both arrays are made once for a text, as the aggregate's input; in its steps they would be made for every match.
    pairs = F.zip_with(gaps, matches, lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        stop = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), x["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), place)["spans"]
    sure = F.filter(placed, lambda x: _confirmed(kind, x["found"]))

    def scored(x: Column) -> Column:
        before = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        around = F.concat(F.substring(text, before + 1, x["start"] - before), F.lit(" "), F.substring(text, x["stop"] + 1, F.lit(CONTEXT_CHARS)))
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(F.lower(around).rlike(f"({CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0))
        return x.withField("score", score)

    kept = F.filter(F.transform(sure, scored), lambda x: F.lit(kind in BASE_KINDS) | (x["score"] >= LEAST_SCORE))
    return F.when(F.size(matches) > 0, kept).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, stop: INT, found: STRING, score: DOUBLE>>)"))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: an array of (start, kind, stop, found, score), by start, then kind as in KINDS.

    Places count code points, stop exclusive; kind is the place in KINDS. Within a kind, matches are leftmost and don't
    overlap, and a match that its validator refuses is dropped; spans of different kinds may overlap. Confirmed spans
    of the base kinds always stay, whatever their score; an IBAN needs mod-97 and an SSN needs words near it. Null
    text counts as empty and gives an empty array. A column named out_col is replaced; all other columns stay, whatever
    their names. Rows that repeat an id are searched each; very long texts cost in proportion. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [k for k in docs.columns if k != out_col]
    prefix = "__pii_"
    while any(k.startswith(prefix) for k in docs.columns):
        prefix = f"_{prefix}"
    own = {kind: f"{prefix}{kind}" for kind in KINDS}
    none = F.expr("CAST(array() AS ARRAY<STRING>)")

    def proposed(kind: str) -> Column:
        all_of = F.regexp_extract_all(text, F.lit(LINEAR_PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(text, F.lit(HINTS[kind])), all_of).otherwise(none) if kind in HINTS else all_of

    out = docs.select(*rest, *(proposed(kind).alias(own[kind]) for kind in KINDS))
    out = out.select(*rest, *(_spans(kind, text, F.col(own[kind])).alias(own[kind]) for kind in KINDS))
    return out.select(*rest, F.array_sort(F.concat(*(F.col(own[kind]) for kind in KINDS))).alias(out_col))


def _named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def mask(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with each found span in the text replaced by its kind in capitals and angle brackets.

    Of overlapping spans the first names the kind and all are covered. Null text stays null.
    """
    text, tags = F.col(text_col), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def put(done: Column, x: Column) -> Column:
        apart = x["start"] >= done["at"]
        piece = F.concat(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.get(tags, x["kind"]))
        return F.struct(F.greatest(done["at"], x["stop"]).alias("at"), F.when(apart, F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    done = F.aggregate(F.col(spans_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    masked = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, masked).otherwise(text))


def pii_digests(found: DataFrame, id_col: str = "doc_id", spans_col: str = "pii") -> DataFrame:
    """Per row: its id, counts of the base kinds, base_sha256, spans and n_spans (of all kinds). Without spans these are 0 and empty."""
    spans = F.col(spans_col)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind"] < len(BASE_KINDS))
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(_named(base), 256).alias("base_sha256"), _named(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document; null and empty texts have no spans."""
    return pii_digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    valid = {
        "email": "true",
        "ip": f"regexp_full_match(m, '{_BYTE}(\\.{_BYTE}){{3}}')",
        "card": "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda k: CASE WHEN k % 2 = 0 THEN substr(d, length(d) - k, 1)::INT ELSE (substr(d, length(d) - k, 1)::INT * 2) % 10 + (substr(d, length(d) - k, 1)::INT * 2) // 10 END)) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
        "ssn": f"regexp_matches(lower(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0)) || ' ' || substr(t, s + length(m) + 1, {CONTEXT_CHARS})), '({CONTEXT['ssn']})')",
    }
    hits = " UNION ALL ".join(
        f"SELECT doc_id, t, {k} AS kind, regexp_extract_all(t, '{PATTERNS[x]}') AS ms, string_split_regex(t, '{PATTERNS[x]}') AS gs FROM docs"
        for k, x in enumerate(KINDS)
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    checks = " ".join(f"WHEN {k} THEN {valid[x]}" for k, x in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(BASE_KINDS))
    one = f"{kinds}[kind + 1] || ':' || s || ':' || (s + length(m))"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
each AS (SELECT doc_id, t, kind, unnest(range(1, len(ms) + 1)) AS k, ms, gs FROM hits WHERE len(ms) > 0),
placed AS (SELECT doc_id, t, kind, ms[k] AS m, regexp_replace(ms[k], '[^0-9]', '', 'g') AS d,
  (list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s FROM each),
sure AS (SELECT doc_id, kind, s, m FROM placed WHERE CASE kind {checks} END),
own AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY s, kind) FILTER (kind < {len(BASE_KINDS)}) AS base, string_agg({one}, ',' ORDER BY s, kind) AS spans, count(*) AS n_spans FROM sure GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN own USING (doc_id)
"""


ORACLE = _oracle()
