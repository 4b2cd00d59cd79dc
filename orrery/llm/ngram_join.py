"""Jaccard join of n-gram sets, size-aware: subsets of small sets, inverted lists of large ones.

A document's set holds the hashes of its distinct n-grams. Equal sets become one class first. A set of at most
``boundary`` n-grams lists every subset that a partner must contain whole; a larger set looks up the inverted lists of
its own n-grams, and sets near the boundary do both. The boundary is where, summed over the sizes that occur, listing
subsets stops being cheaper than reading lists of the length measured.

Lists are cut by prefix filters that lose no pair. Linked sets A and B share all but floor(0.2|A|) of A's n-grams, so
among the first floor(0.2|A|) + m n-grams by hash they share at least m (``leading``). Only these are counted in the
corpus, and of them the rarest floor(0.2|A|) + 1 + (m's change between partners' sizes) must hold a common one
(``prefix``). N-grams that occur once find nothing and are left out, so passages that many documents share cost
nothing unless a document consists of little else.

Texts are dealt out in chunks. A chunk sends its n-grams' counts to buckets by hash; a bucket sums them and answers
every chunk, so that an n-gram of a third of all documents is one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded, cut, release, table, tidy
from .components import components
from .exact_dedup import tree_merge

WORDS = 5
#: Similarity as a fraction: linked when PER * shared >= LEAST * union.
LEAST, PER = 80, 100
DOCS_PER_CHUNK, GRAMS_PER_CHUNK, BYTES_PER_CHUNK = 2000, 1 << 21, 16 << 20
ENTRIES_PER_BUCKET = 1 << 20
LEAST_CHUNKS = LEAST_BUCKETS = 64
LARGEST_BOUNDARY = 16
SLICE_BYTES = 4 << 20
RELEASE_EVERY = 4
#: Lists beyond LONG members are compared in tasks, about PART members or PART_GRAMS n-grams with as many at a time.
LONG, PART, PART_GRAMS, BAND = 256, 4096, 1 << 22, 256
#: N-grams of up to FEW sets are counted by pairs, others by matrix products over so many columns.
FEW, COLUMNS = 16, 1024
_ODD = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's set: sorted distinct hashes of its n-grams, A-Z folded; fewer words make one n-gram, none an empty set."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds, flat = np.asarray(split.offsets, dtype=np.int64), split.flatten()
    bounds = bounds - bounds[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in known), np.uint64, len(known))[np.asarray(coded.indices, dtype=np.int64)] if known else np.zeros(0, np.uint64)
    most = max(0, len(word) - words + 1)
    run = np.full(most, words, np.uint64)
    for k in range(words):
        run += word[k : k + most] * _ODD[k]
    run = _mixed(run)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            out.append(_mixed(np.array([(word[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def partners(n: int, least: int = LEAST, per: int = PER) -> tuple[int, int]:
    """The smallest and largest size of a set that one of n can be linked with."""
    return _ceil(least * n, per), per * n // least


def shared(n: int, m: int, least: int = LEAST, per: int = PER) -> int:
    """How many n-grams linked sets of these sizes share at least."""
    return _ceil(least * (n + m), per + least)


def extra(n: int) -> int:
    return max(1, n // 5)


def leading(n: int, least: int = LEAST, per: int = PER) -> int:
    return min(n, n - partners(n, least, per)[0] + extra(n))


def prefix(n: int, least: int = LEAST, per: int = PER) -> int:
    low = partners(n, least, per)[0]
    return min(leading(n, least, per), n - low + extra(n) - extra(low) + 1)


def subset_sizes(n: int, least: int = LEAST, per: int = PER) -> list[int]:
    low, high = partners(n, least, per)
    return sorted({c for m in range(low, high + 1) if (c := shared(n, m, least, per)) <= min(n, m)})


def boundary_by_cost(sizes: dict[int, int], list_length: float, least: int = LEAST, per: int = PER, most: int = LARGEST_BOUNDARY) -> int:
    """The boundary with the least cost, given how many sets have each size and how long a list is on average."""

    def cost(x: int) -> float:
        listed = sum(k * math.comb(n, c) for n, k in sizes.items() if 0 < n <= x for c in subset_sizes(n, least, per))
        return listed + sum(k * prefix(n, least, per) * list_length for n, k in sizes.items() if n > 0 and n >= partners(x + 1, least, per)[0])

    return min(range(most + 1), key=lambda x: (cost(x), x))


def _combined(grams: np.ndarray) -> np.ndarray:
    """A hash for each row of n-grams, unlike those of rows of another width."""
    return _mixed((_mixed(grams) * _ODD[np.arange(grams.shape[1]) % 64]).sum(axis=1, dtype=np.uint64) + np.array([grams.shape[1]], np.uint64) * _ODD[63])


def subset_keys(grams: np.ndarray, least: int = LEAST, per: int = PER) -> list[int]:
    """A key for each subset that a set of a size that can be linked must contain."""
    return [k for size in subset_sizes(len(grams), least, per) for k in _combined(np.array(list(combinations(grams, size)), np.uint64)).tolist()]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES)) + 1
        yield batch.slice(begin, stop - begin)
        begin = stop


def _tidy_groups(run):
    """``run``, a function of a key and its tables, releasing memory after every RELEASE_EVERY groups."""
    done = 0

    def count() -> None:
        nonlocal done
        done += 1
        if done % RELEASE_EVERY == 0:
            release()

    if run.__code__.co_argcount == 3:

        def two(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = run(key, left, right)
            count()
            return out

        return two

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        count()
        return out

    return one


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """_id, _n, _a and _b (a 128-bit hash of the set), _first (its smallest hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                sets = gram_sets(part.column(1), words)
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(x), 2**64) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                first = np.array([x[0] if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(first)], ["_id", "_n", "_a", "_b", "_first"])

    return docs.mapInArrow(tidy(run), "_id long, _n long, _a long, _b long, _first long")


def _of_classes(texts: pa.Table, ids: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, set) of the chunk's rows that stand for a class."""
    own = texts.filter(pc.is_in(texts.column("_id"), value_set=ids.drop_null())).select(["_id", "_text"]).combine_chunks()
    for batch in own.to_batches():
        for part in _slices(batch, 1):
            yield from zip(part.column(0).to_pylist(), gram_sets(part.column(1), words))


def candidate_keys(texts: DataFrame, classes: DataFrame, boundary: int, chunks: int, buckets: int, words: int, least: int, per: int) -> DataFrame:
    """_id, _n, _set, _keys, _places (how many leading n-grams come before each key) and _top (half the largest leading hash) of every class with a key that another class may share."""
    floor = partners(boundary + 1, least, per)[0]
    blob = [("_chunk", pa.int64()), ("_hashes", pa.binary()), ("_counts", pa.binary())]

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = [x[: leading(len(x), least, per)] for _, x in _of_classes(left, right.column("_id").combine_chunks(), words) if len(x) >= floor and len(x)]
        if not held:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["_bucket", "_chunk", "_hashes", "_counts"])
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        # Buckets are ranges of the mixed hash: leading n-grams are those with small hashes.
        bucket = ((_mixed(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hashes, counts, cuts = hashes[order], counts[order].astype(np.uint32), np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(k, hashes[a:b].tobytes(), _sparse(counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.table([pa.array([k for k, _, _ in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())], names=["_bucket", "_chunk", "_hashes", "_counts"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        chunk = np.asarray(table.column("_chunk"))
        parts = [np.frombuffer(x, np.uint64) for x in table.column("_hashes").to_pylist()]
        counts = np.concatenate([_dense(x, len(p)) for x, p in zip(table.column("_counts").to_pylist(), parts)])
        source = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        hashes, counts, source = hashes[order], counts[order], source[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        total = np.repeat(np.add.reduceat(counts, begin), np.diff(np.append(begin, len(hashes))))
        again = np.flatnonzero(total > 1)
        again = again[np.argsort(source[again], kind="stable")]
        cuts = np.searchsorted(source[again], np.arange(len(parts) + 1))
        rows = [(int(chunk[k]), hashes[again[a:b]].tobytes(), total[again[a:b]].astype(np.uint64).tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.table([pa.array([x[k] for x in rows], t) for k, (_, t) in enumerate(blob)], names=[n for n, _ in blob])

    def choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.filter(pc.is_valid(right.column("_hashes")))
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in known.column("_hashes").to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in known.column("_counts").to_pylist())])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        ids, sizes, sets, keys, places, tops = [], [], [], [], [], []
        for k, grams in _of_classes(left, right.column("_id").combine_chunks(), words):
            n, own, place = len(grams), [], []
            if n and n >= floor and len(hashes):
                lead = grams[: leading(n, least, per)]
                at = np.minimum(np.searchsorted(hashes, lead), len(hashes) - 1)
                seen = hashes[at] == lead
                room = prefix(n, least, per) - int((~seen).sum())  # those that occur once come first
                if room > 0:
                    often, lead = counts[at[seen]], lead[seen]
                    own = lead[np.lexsort((lead, often))[:room]].tolist()
                    place = range(int((~seen).sum()), int((~seen).sum()) + len(own))
            if 0 < n <= boundary:
                own += subset_keys(grams, least, per)
            if own:
                ids.append(k), sizes.append(n), sets.append(grams.view(np.int64)), keys.append(np.array(own, np.uint64).view(np.int64))
                places.append([*place, *[0] * (len(own) - len(place))])
                lead = leading(n, least, per)
                tops.append(int(grams[lead - 1] >> np.uint64(1)) if lead < n else 2**63 - 1)
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(tops, pa.int64())], names=["_id", "_n", "_set", "_keys", "_places", "_top"])

    sent = texts.groupBy("_chunk").cogroup(classes.groupBy("_chunk")).applyInArrow(_tidy_groups(send), "_bucket long, _chunk long, _hashes binary, _counts binary")
    answers = sent.groupBy("_bucket").applyInArrow(_tidy_groups(answer), "_chunk long, _hashes binary, _counts binary")
    right = answers.withColumn("_id", F.lit(None).cast("long")).unionByName(classes.select("_chunk", F.lit(None).cast("binary").alias("_hashes"), F.lit(None).cast("binary").alias("_counts"), "_id"))
    return texts.groupBy("_chunk").cogroup(right.groupBy("_chunk")).applyInArrow(_tidy_groups(choose), "_id long, _n long, _set array<long>, _keys array<long>, _places array<int>, _top long")


def _sparse(counts: np.ndarray) -> bytes:
    """Where a count is over 1, and that count."""
    at = np.flatnonzero(counts > 1).astype(np.uint32)
    return np.concatenate([at, counts[at]]).astype(np.uint32).tobytes()


def _dense(data: bytes, n: int) -> np.ndarray:
    out, pairs = np.ones(n, np.int64), np.frombuffer(data, np.uint32).reshape(2, -1)
    out[pairs[0]] = pairs[1]
    return out


def _alike(a: str, b: str, least: int, per: int) -> str:
    return f"{per} * least({a}, {b}) >= {least} * greatest({a}, {b})"


def verified(pairs: DataFrame, sets: DataFrame, least: int, per: int) -> DataFrame:
    """Of the pairs (_x, _y) those that are linked."""
    one = sets.select(F.col("_id").alias("_x"), F.col("_n").alias("_nx"), F.col("_set").alias("_sx"))
    two = sets.select(F.col("_id").alias("_y"), F.col("_n").alias("_ny"), F.col("_set").alias("_sy"))
    both = pairs.join(two, "_y").join(one, "_x").select("_x", "_y", "_nx", "_ny", F.size(F.array_intersect("_sx", "_sy")).alias("_both"))
    return both.where(f"{per} * _both >= {least} * (_nx + _ny - _both)").select("_x", "_y").distinct()


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``one`` shares with each of ``two``: frequent n-grams by matrix products, the others by their pairs."""
    out = np.zeros((len(one), len(two)), np.float32)
    gram = np.concatenate(one + two)
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in one + two])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(begin, len(gram)))
    column, size = np.repeat(np.arange(len(begin)), length), np.repeat(length, length)
    few = (size > 1) & (size <= FEW)
    r, c = row[few], column[few]
    for d in range(1, FEW):
        if len(c) > d and len(at := np.flatnonzero((c[d:] == c[:-d]) & (r[:-d] < len(one)) & (r[d:] >= len(one)))):
            np.add.at(out, (r[at], r[at + d] - len(one)), 1)
    many = size > FEW
    r, (_, c) = row[many], np.unique(column[many], return_inverse=True) if many.any() else (None, np.zeros(0, int))
    for at in range(0, int(c.max()) + 1 if len(c) else 0, COLUMNS):
        here = (c >= at) & (c < at + COLUMNS)
        x = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        x[r[here], c[here] - at] = 1
        out += x[: len(one)] @ x[len(one) :].T
    return out


def _long_lists(apart: DataFrame, keyed: DataFrame, lengths: DataFrame, least: int, per: int) -> DataFrame:
    """Joins (_x, _y) between components that links within long lists give; a list is dealt out in parts, and a task compares two of them."""

    def run(key: tuple, members: pa.Table) -> pa.Table:
        _, first, second = (x.as_py() for x in key)
        part, n, of = (np.asarray(members.column(k)) for k in ("_part", "_n", "_of"))
        sets = [np.asarray(x.values) for x in members.column("_set").combine_chunks()]
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        edges = np.zeros((0, 2), np.int64)
        if len(a) and len(b) and len(np.unique(of)) > 1:
            found = []
            for at in range(0, len(a), BAND):  # a band of rows at a time bounds memory
                band = a[at : at + BAND]
                both = overlaps([sets[k] for k in band], [sets[k] for k in b]).astype(np.int32)
                linked = (per + least) * both >= least * (n[band][:, None] + n[b][None, :])
                i, j = np.nonzero(linked & (of[band][:, None] != of[b][None, :]))
                found.append(np.unique(np.stack([of[band[i]], of[b[j]]], axis=1), axis=0))
            edges = np.unique(np.concatenate(found), axis=0)
        names, ends = np.unique(edges, return_inverse=True)
        ends, root = ends.reshape(-1, 2), np.arange(len(names))
        while True:  # one join to the smallest for each component, however many links
            low = root.copy()
            np.minimum.at(low, ends[:, 0], root[ends[:, 1]])
            np.minimum.at(low, ends[:, 1], root[ends[:, 0]])
            if (low == root).all():
                break
            root = low
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table([pa.array(names[root[moved]], pa.int64()), pa.array(names[moved], pa.int64())], names=["_x", "_y"])

    parts = F.ceil(F.greatest(F.col("_length") / PART, F.col("_grams") / PART_GRAMS)).cast("int")
    dealt = (
        apart.join(lengths.where(F.col("_length") > LONG), "_key")
        .select("_key", "_id", "_n", "_of", F.pmod(F.xxhash64("_id"), parts).cast("int").alias("_part"), parts.alias("_parts"))
        .select("*", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_other"))
        .select("_key", "_id", "_n", "_of", "_part", F.least("_part", "_other").alias("_one"), F.greatest("_part", "_other").alias("_two"))
    )
    return dealt.join(keyed.select("_id", "_set"), "_id").groupBy("_key", "_one", "_two").applyInArrow(_tidy_groups(run), "_x long, _y long")


def class_components(keyed: DataFrame, least: int, per: int) -> DataFrame:
    """(node, component) of every class that is linked with another.

    Each list's members are first held against one of them, that with the fewest n-grams of its own before the key: the
    likeliest to be linked with many. Members that are still apart afterwards are then held against each other: those of
    lists up to LONG as pairs, so that a posting makes at most LONG of them, those of longer lists in blocks within
    tasks, which return joins between components and no pairs. So near copies cost the length of their lists in rows,
    and no link between components is lost.
    """
    own = ["_id", "_n", "_place", "_top"]
    postings = keyed.select("_id", "_n", "_top", F.explode(F.arrays_zip("_keys", "_places")).alias("_p")).select("_id", "_n", "_top", F.col("_p._keys").alias("_key"), F.col("_p._places").alias("_place"))

    def near_enough(a: str, b: str) -> str:
        """Whether the pair may be linked if the key is the first that both have; at that key it is, so others may leave it out.

        Of the set whose leading n-grams end first, those before the key are then in no part of the other set.
        """
        few = lambda x: f"{per + least} * (_n{x} - _place{x}) >= {least} * (_n{a} + _n{b})"
        return f"{_alike(f'_n{a}', f'_n{b}', least, per)} AND CASE WHEN _top{a} <= _top{b} THEN {few(a)} ELSE {few(b)} END"

    heads = postings.groupBy("_key").agg(F.min(F.struct("_place", "_id", "_n", "_top")).alias("_h"), F.count(F.lit(1)).alias("_length")).where("_length > 1").select("_key", "_length", *(F.col(f"_h.{c}").alias("_x" if c == "_id" else f"{c}x") for c in own))
    listed = postings.select("_key", *(F.col(c).alias("_y" if c == "_id" else f"{c}y") for c in own)).join(heads, "_key")
    stars = cut(listed.where("_x <> _y").where(near_enough("x", "y")).select("_x", "_y").distinct())
    links = cut(verified(stars, keyed, least, per))
    near = components(links, "_x", "_y")
    labelled = postings.join(near.withColumnRenamed("node", "_id"), "_id", "left").select("_key", *own, F.coalesce("component", "_id").alias("_of"))
    mixed = labelled.groupBy("_key").agg(F.min("_of").alias("_low"), F.max("_of").alias("_high"), F.count(F.lit(1)).alias("_length"), F.sum("_n").alias("_grams")).where("_low < _high").select("_key", "_length", "_grams")
    apart = cut(labelled.join(mixed.drop("_grams"), "_key"))
    short = apart.where(F.col("_length") <= LONG)
    one, two = (short.select("_key", *(F.col(k).alias(k + side) for k in (*own, "_of"))) for side in "xy")
    pairs = one.join(two, "_key").where("_idx < _idy AND _ofx <> _ofy").where(near_enough("x", "y")).select(F.col("_idx").alias("_x"), F.col("_idy").alias("_y")).distinct()
    joins = _long_lists(apart.drop("_length"), keyed, mixed, least, per)
    links = links.unionByName(verified(pairs, keyed, least, per)).unionByName(joins)
    return components(links, "_x", "_y")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST, per: int = PER) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z folded. A set holds the distinct n-grams of a text; fewer words make
    one n-gram, and null, empty or blank text an empty set that links with nothing. Two documents link when
    per * shared >= least * union. component_id is the smallest id reachable by links. Rows that repeat an id count as one
    document with several texts; a row without an id links with nothing and has no component. Other columns aren't looked
    at. An empty table gives no rows.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = cut(_classes(rows, words))
    total, grams = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    chunks = max(LEAST_CHUNKS, _ceil(total, DOCS_PER_CHUNK), _ceil(grams, GRAMS_PER_CHUNK), _ceil(size, BYTES_PER_CHUNK))
    chunk = F.pmod(F.xxhash64("_id"), F.lit(chunks)).alias("_chunk")
    member = cut(tree_merge(found.where("_id IS NOT NULL AND _n > 0"), ["_n", "_a", "_b"], keep="min", rows=total))
    classes = member.where("_id = _keep").select("_id", "_n", "_first").distinct()
    sizes = {n: k for n, k in classes.where(F.col("_n") <= 2 * LARGEST_BOUNDARY).groupBy("_n").count().collect()}
    length = classes.groupBy("_first").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 1.0
    boundary = boundary_by_cost(sizes, length, least, per)
    texts = rows.where("_id IS NOT NULL").select(chunk, "_id", "_text")
    keyed = cut(candidate_keys(texts, classes.select(chunk, "_id").distinct(), boundary, chunks, max(LEAST_BUCKETS, _ceil(grams * 2 // 5, ENTRIES_PER_BUCKET)), words, least, per))
    near = class_components(keyed, least, per)
    of_class = member.select("_id", "_n", "_keep").join(near.withColumnRenamed("node", "_keep"), "_keep", "left").select("_id", "_n", F.coalesce("component", "_keep").alias("_of"))
    rest = found.where("_id IS NULL OR _n = 0").select("_id", "_n", F.col("_id").alias("_of"))
    return of_class.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_of").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; null, empty and blank texts have 0 shingles and are components of their own."""
    return ngram_components(table(spark, sf_dir, "documents"))


#: All pairs with an n-gram in common, counted; then what each document reaches.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda k: array_to_string(ws[k:k + {WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {PER} * shared >= {LEAST} * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
