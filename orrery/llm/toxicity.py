"""A toxicity classifier whose score doesn't hang on which group a sentence names.

Labelled texts become sets of words. Words, and beginnings of words, that tell the labels apart beyond chance (by the
likelihood ratio, corrected for how many were tried) and all identity terms are features of a logistic regression. For
every labelled text that names a group, each of its sentences is also taken with that term swapped for every other one of its kind; the fit
penalises the square of the change of the text's logit. The quadratic penalty joins the Newton steps exactly.

Texts are read in time linear in their length, in training as in scoring. The driver gets one bit for each feature of at
most ``TRAIN_ROWS`` texts, and the swaps added up over all texts, of which there are no more than pairs of identity terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table, tidy, whole_row

#: The fit sees at most so many labelled rows: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: The model has at most so many words, the surest first, and the identity terms: a bound on the model, which every task holds.
MOST_FEATURES = 2000
CHANCE = 0.05
RIDGE = 0.05
SWAP_PENALTY = 10.0
#: Labelled texts whose so many smallest word hashes are equal may be copies or near copies.
SKETCH = 3
#: Of these, texts that share so much of their words (of either) count once.
NEAR = 0.8
#: Beginnings of longer words are features, too: endings vary.
PREFIXES = (4, 5, 6, 7)
STEPS = 50
FOLDS = 5
#: Rows of the dense matrix that a Newton step takes at a time.
FIT_ROWS = 1000
#: Words whose features a worker remembers.
KNOWN_WORDS = 500_000

# Identity terms by language and kind.
IDENTITY_TERMS = {
    "en religion": ["atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant", "sikh"],
    "en origin": ["african", "american", "arab", "asian", "black", "chinese", "european", "immigrant", "indian", "latino", "mexican", "white"],
    "en gender": ["female", "girl", "boy", "male", "man", "men", "nonbinary", "trans", "transgender", "woman", "women"],
    "en orientation": ["bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight"],
    "en condition": ["blind", "deaf", "disabled", "elderly", "old", "paralyzed", "young"],
    "de religion": ["atheist", "buddhist", "christ", "hindu", "jude", "katholik", "moslem", "muslim", "protestant"],
    "de origin": ["afrikaner", "araber", "asiate", "ausländer", "chinese", "deutscher", "europäer", "flüchtling", "inder", "mexikaner", "migrant", "türke"],
    "de gender": ["frau", "frauen", "junge", "mann", "männer", "mädchen", "transfrau", "transmann"],
    "de orientation": ["bisexuell", "heterosexuell", "homosexuell", "lesbisch", "queer", "schwul"],
    "de condition": ["alt", "behindert", "blind", "gelähmt", "gehörlos", "jung", "taub"],
    "es religion": ["ateo", "budista", "católico", "cristiano", "hindú", "judío", "musulmán", "protestante"],
    "es origin": ["africano", "americano", "asiático", "blanco", "chino", "europeo", "gitano", "inmigrante", "latino", "mexicano", "negro", "árabe"],
    "es gender": ["chica", "chico", "hombre", "hombres", "mujer", "mujeres", "niña", "niño", "transexual", "transgénero"],
    "es orientation": ["bisexual", "gay", "heterosexual", "homosexual", "lesbiana", "queer"],
    "es condition": ["anciano", "ciego", "discapacitado", "joven", "paralítico", "sordo", "viejo"],
    "fr religion": ["athée", "bouddhiste", "catholique", "chrétien", "hindou", "juif", "musulman", "protestant"],
    "fr origin": ["africain", "américain", "arabe", "asiatique", "blanc", "chinois", "européen", "immigré", "indien", "mexicain", "migrant", "noir"],
    "fr gender": ["femme", "femmes", "fille", "garçon", "homme", "hommes", "transgenre", "transsexuel"],
    "fr orientation": ["bisexuel", "gay", "homosexuel", "hétérosexuel", "lesbienne", "queer"],
    "fr condition": ["aveugle", "handicapé", "jeune", "paralysé", "sourd", "vieux", "âgé"],
}
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def tokens(texts: pa.Array) -> pa.ListArray:
    """The words of each text, in order: runs of letters, in lower case; some are empty."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}]+")


def words(text: str | None) -> set[str]:
    return set(tokens(pa.array([text], pa.string()))[0].as_py()) - {""}


def features(own: set[str], lengths: tuple[int, ...] = PREFIXES) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a star."""
    return own | {f"{w[:k]}*" for w in own for k in lengths if len(w) > k}


def others(terms: dict[str, list[str]] = IDENTITY_TERMS) -> dict[str, list[str]]:
    """For each identity term the others of its kinds."""
    out: dict[str, set[str]] = {}
    for kind in terms.values():
        for term in kind:
            out.setdefault(term, set()).update(x for x in kind if x != term)
    return {term: sorted(x) for term, x in out.items()}


def swaps(text: str | None, swapped: dict[str, list[str]] | None = None) -> Counter[tuple[frozenset[str], frozenset[str]]]:
    """How often the text loses and gains which features as an identity term of a sentence is swapped for each other one.

    Features are counted once for the text, by sentence, and once for each sentence that names a group, by word.
    """
    swapped = _OTHERS if swapped is None else swapped
    parts = [set(x) - {""} for x in tokens(pa.array(_SENTENCE.findall(text or ""), pa.string())).to_pylist()]
    out: Counter[tuple[frozenset[str], frozenset[str]]] = Counter()
    if not any(swapped.keys() & own for own in parts):
        return out
    sentences = Counter(f for own in parts for f in features(own))
    for own in parts:
        named = swapped.keys() & own
        if not named:
            continue
        inside = Counter(f for w in own for f in features({w}))
        for term in named:
            gone = features({term})

            def without(new: set[str]) -> frozenset[str]:
                """Those of ``new`` that the text doesn't have once the term is out of this sentence."""
                return frozenset(f for f in new if sentences[f] <= (f in inside) and inside[f] <= (f in gone))

            lost = without(gone)
            for other in swapped[term]:
                out[lost, without(features({other}))] += 1
    return out


_OTHERS = others()


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    _known: dict[str, list[int]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self._place = {w: k for k, w in enumerate(self.weights)}
        self._weight = np.array([*self.weights.values(), 0.0])
        self._lengths = tuple(sorted({len(w) - 1 for w in self.weights if w.endswith("*")}))

    def _of(self, word: str) -> list[int]:
        if (own := self._known.get(word)) is None:
            if len(self._known) > KNOWN_WORDS:
                self._known.clear()
            own = self._known[word] = [self._place[f] for f in features({word}, self._lengths) if f in self._place] if word else []
        return own

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; only the distinct words are looked up one by one."""
        found = tokens(texts)
        code = found.flatten().dictionary_encode()
        own = [self._of(w) for w in code.dictionary.to_pylist()]
        flat = np.array([k for x in own for k in x], np.int64)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        index = np.asarray(code.indices, dtype=np.int64)
        row, many = np.repeat(np.arange(len(found)), np.asarray(pc.list_value_length(found))), np.diff(begin)[index]
        row, index, many = row[many > 0], index[many > 0], many[many > 0]
        at = np.repeat(begin[index] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair = np.unique(np.repeat(row, many) * len(self._weight) + flat[at])  # a text has a feature once
        z = self.bias + np.bincount(pair // len(self._weight), self._weight[pair % len(self._weight)], len(found))
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1, e) / (1 + e)

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def least_deviance(tried: int, chance: float = CHANCE) -> float:
    """The square of the normal quantile at ``chance`` / ``tried``, by its usual expansion."""
    t = math.sqrt(2 * math.log(2 * max(1, tried) / chance))
    return (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)) ** 2


def choose_features(texts: DataFrame, chance: float = CHANCE, most: int = MOST_FEATURES) -> list[str]:
    """Words whose counts by label would arise by chance once in 1 / ``chance`` fits, the surest first, and all identity terms seen.

    texts: _label and _words (distinct) of each labelled text.
    """
    rows, positives = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not 0 < positives < rows:
        return []
    seen = texts.select("_label", F.explode("_words").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"), F.sum("_label").alias("_bad")).where("_n > 1")
    tried = seen.count()

    def part(x: Column, n: Column, share: float) -> Column:
        return F.when(x > 0, 2 * x * F.log(x / (n * share))).otherwise(0.0)

    p, n, bad = positives / rows, F.col("_n").cast("double"), F.col("_bad").cast("double")
    gain = part(bad, n, p) + part(n - bad, n, 1 - p) + part(positives - bad, rows - n, p) + part(rows - n - positives + bad, rows - n, 1 - p)
    kept = seen.select("_word", gain.alias("_gain")).where(F.col("_gain") >= least_deviance(tried, chance)).orderBy(F.desc("_gain"), "_word").limit(most).collect()
    named = seen.where(F.col("_word").isin(sorted(_OTHERS))).select("_word").collect()
    return sorted({r[0] for r in kept} | {r[0] for r in named})


def fit(x: np.ndarray, labels: np.ndarray, counts: np.ndarray, changes: list[tuple[set[str], set[str], float]], names: list[str], ridge: float = RIDGE, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Minimises the deviance of ``counts`` texts of features ``x`` (0 or 1) plus the penalties.

    changes: (features lost, features gained, weight) of the swaps. Without features the score is the smoothed share of ones.
    """
    base = (float(counts @ labels) + 0.5) / (float(counts.sum()) + 1)
    if not names:
        return Model(math.log(base / (1 - base)), {})
    size, place = len(names) + 1, {w: k for k, w in enumerate(names)}
    penalty = np.diag([ridge] * len(names) + [0.0])
    for lost, gained, weight in changes:
        d = np.zeros(size)
        d[[place[w] for w in gained if w in place]] += 1
        d[[place[w] for w in lost if w in place]] -= 1
        at = np.flatnonzero(d)
        penalty[np.ix_(at, at)] += swap_penalty * weight * np.outer(d[at], d[at])
    w = np.zeros(size)
    w[-1] = math.log(base / (1 - base))

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(0, len(x), FIT_ROWS):
            dense = np.ones((len(x[k : k + FIT_ROWS]), size))
            dense[:, :-1] = x[k : k + FIT_ROWS]
            yield dense, labels[k : k + FIT_ROWS], counts[k : k + FIT_ROWS]

    def loss(w: np.ndarray) -> float:
        return sum(float(n @ (np.logaddexp(0, z := a @ w) - y * z)) for a, y, n in parts()) + 0.5 * float(w @ penalty @ w)

    now = loss(w)
    for _ in range(STEPS):
        bend, slope = penalty + 1e-9 * np.eye(size), -penalty @ w
        for a, y, n in parts():
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            bend += (a * (n * p * (1 - p))[:, None]).T @ a
            slope += a.T @ (n * (y - p))
        step, reach = np.linalg.solve(bend, slope), 1.0
        while reach > 1e-6 and loss(w + reach * step) > now:
            reach /= 2
        w, before, now = w + reach * step, now, loss(w + reach * step)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return Model(float(w[-1]), {n: float(v) for n, v in zip(names, w) if v})


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def distinct_texts(texts: DataFrame, near: float = NEAR) -> DataFrame:
    """_row of the texts that stay: those that don't share ``near`` of their words with an earlier one of their sketch and label that stays.

    Only hashes of the words come together, once for each set of words.
    """
    marks = F.transform(F.filter("_words", lambda w: ~w.endswith("*")), lambda w: F.xxhash64(w))
    light = texts.select("_sketch", "_label", F.sort_array(marks).alias("_marks"), F.struct("_id", F.xxhash64("_swaps").alias("_held"), "_row").alias("_at"))
    sets = light.groupBy("_sketch", "_label", F.md5(F.array_join(F.col("_marks").cast("array<string>"), " ").cast("binary"))).agg(F.min(F.struct("_at", "_marks")).alias("_one"))

    def alike(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        return common >= near * (F.size(a) + F.size(b) - common)

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: alike(k["_marks"], x["_marks"])), kept).otherwise(F.concat(kept, F.array(x)))

    groups = sets.groupBy("_sketch", "_label").agg(F.sort_array(F.collect_list("_one")).alias("_all"))
    return groups.select(F.explode(F.aggregate("_all", F.slice("_all", 1, 0), step)).alias("_one")).select("_one._at._row")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, terms: dict[str, list[str]] = IDENTITY_TERMS) -> Model:
    """Fits a Model on at most ``most`` rows whose fold isn't 0, chosen by the hash of their id.

    Null labels and ids don't count; of several labels for an id the largest holds. Null texts are empty. Rows that repeat
    an id are texts of their own, near copies count once. Without usable rows every score is 0.5. ``terms``: identity
    terms by language and kind.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL").where(fold(F.col("_id")) != 0)
    chosen = usable.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    swapped = others(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text"))
            sets = [sorted(set(x) - {""}) for x in tokens(text).to_pylist()]
            held, share = [], []
            for x, of in zip(text.to_pylist(), sets):
                found = swaps(x, swapped) if not swapped.keys().isdisjoint(of) else {}
                own = sorted((" ".join(sorted(a)) + "|" + " ".join(sorted(b)), n) for (a, b), n in found.items())
                held.append([k for k, _ in own])
                share.append([n / sum(m for _, m in own) for _, n in own])
            sketch = [" ".join(sorted(xxhash.xxh3_64_hexdigest(w) for w in x)[:SKETCH]) for x in sets]
            kinds = ((sets, pa.list_(pa.string())), (held, pa.list_(pa.string())), (share, pa.list_(pa.float64())), (sketch, pa.string()))
            words_of = [sorted(features(set(x))) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in ("_id", "_label")] + [pa.array(words_of, pa.list_(pa.string())), *(pa.array(v, t) for v, t in kinds[1:])], ["_id", "_label", "_words", "_swaps", "_shares", "_sketch"]
            )

    # chosen holds two numbers for each of at most ``most`` rows, so it may be broadcast.
    found = texts.join(F.broadcast(chosen), "_id").mapInArrow(tidy(read), "_id long, _label int, _words array<string>, _swaps array<string>, _shares array<double>, _sketch string").withColumn("_label", (F.col("_label") > 0).cast("int"))
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    # One number for each text that stays.
    found = found.join(F.broadcast(cut(distinct_texts(found))), "_row", "left_semi")
    names = choose_features(found)
    place = {w: k for k, w in enumerate(names)}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(place)), np.uint8)
            for k, own in enumerate(batch.column(1).to_pylist()):
                bits[k, [place[w] for w in own if w in place]] = 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["_label", "_bits"])

    # What goes to the driver: a bit for each feature of the distinct rows, and one number for each kind of swap.
    rows = found.select("_label", "_words").mapInArrow(tidy(marked), "_label int, _bits binary").groupBy("_label", "_bits").count().collect()
    rows = sorted((bytes(bits), label, n) for label, bits, n in rows)
    weighed = found.select(F.explode(F.arrays_zip("_swaps", "_shares")).alias("_s")).groupBy("_s._swaps").agg(F.sum(F.col("_s._shares").cast("decimal(30,15)")).cast("double").alias("_weight")).collect()
    changes = [(*(set(x.split()) for x in swap.split("|")), weight) for swap, weight in sorted(map(tuple, weighed))]
    x = np.unpackbits(np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(names)] if names else np.zeros((len(rows), 0), np.uint8)
    return fit(x, np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64), changes, names)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, 0 to 1; null text scores as empty text; a column named out_col is replaced. The model is bounded by MOST_FEATURES and travels with the task."""

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(model.scores(pa.array(texts, pa.string())))

    return bounded(docs).withColumn(out_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, all columns kept, whatever their names. Null and empty texts have the model's bias; an empty table gives no rows."""
    rows = docs.select(whole_row(docs.columns))
    return score(rows.withColumn("_text", F.col("_row")[text_col]), model, "_text", "_score").where(F.col("_score") < limit).select("_row.*")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_on: DataFrame | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    The model is fitted on labelled rows of ``fit_on`` (by default docs) outside fold 0; held_out tells whether a row is in
    fold 0. Null and empty texts have a score too (the model's bias); a null id has a null held_out. Rows that repeat an id
    are scored each; other columns aren't looked at. An empty table gives no rows; without usable labels every
    score is 0.5.
    """
    model = train(fit_on if fit_on is not None else docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text", "_score")
    return scored.select(F.col("_id").alias(id_col), (fold(F.col("_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; null and empty texts have a score, rows that repeat an id one each."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
