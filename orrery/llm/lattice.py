"""Embedding near-dedup by lattice hashing.

Each table projects a vector at random to one or more blocks of eight dimensions and decodes every block to the nearest
point of the E8 lattice; the points together are its cell. A vector also enters the cells of the neighbouring lattice
points that come next (probes). Two vectors that share a cell in any table are compared by cosine in double precision. A
cell's members are compared in blocks, so no task holds an unbounded cell and no pair leaves a task: a block returns how
many links each member has and one link that joins it to its group. A pair is counted in the first cell that both its
vectors have.

Cells shrink with the corpus: ``ladder`` takes blocks, scale and tables from the number of vectors, so that the share of
all pairs that is compared falls while a pair of cosine 0.9 still shares a cell with probability 0.98, one of 0.95 with
0.999 (measured by tests/llm/test_lattice.py on every rung).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table, tidy
from .components import components
from .exact_dedup import tree_merge

THRESHOLD = 0.9
PROBES = 2
#: (vectors fewer than, lattice blocks, scale, tables): each rung has cells so much smaller that the share of unlike pairs
#: that meet falls (0.02, 0.005, 0.002, 0.001, 1e-4, 4e-5, 9e-6, 2e-6), and tables for the same recall.
LADDER = ((1 << 14, 1, 0.70, 6), (1 << 16, 2, 0.42, 7), (1 << 18, 2, 0.46, 9), (1 << 20, 2, 0.50, 12), (1 << 23, 3, 0.42, 19), (1 << 26, 3, 0.46, 26), (1 << 29, 4, 0.40, 40), (None, 4, 0.44, 61))
BLOCK = 512
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for pair in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[list(pair)] = signs
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if np.signbit(s).sum() % 2 == 0]
    return np.array(out)


ROOTS = roots()
_ROOTS32 = np.ascontiguousarray(ROOTS.T.astype(np.float32))


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole entries and an even sum: round, and turn the worst entry round if the sum is odd."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def ladder(rows: int) -> tuple[int, float, int]:
    """Lattice blocks, scale and tables for so many vectors."""
    return next(rung[1:] for rung in LADDER if rung[0] is None or rows < rung[0])


def cells(x: np.ndarray, blocks: int, scale: float, tables: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """The cells of unit vectors: for each table the own one and the probes, as 64-bit keys."""
    random = np.random.default_rng([seed, x.shape[1]])
    out, rows, wide = np.empty((len(x), tables, probes + 1), np.int64), np.arange(len(x)), 8 * blocks
    for t in range(tables):
        turn, shift = random.normal(size=(x.shape[1], wide)), random.uniform(size=wide)
        odd = random.integers(1, 2**61, wide + 1, dtype=np.int64) * 2 + 1
        y = (x @ turn * scale + shift).reshape(len(x) * blocks, 8)
        own = nearest_e8(y)
        gain = ((y - own).astype(np.float32) @ _ROOTS32).reshape(len(x), blocks * len(ROOTS))
        step = np.concatenate([(ROOTS * 2).astype(np.int64) @ odd[8 * k : 8 * k + 8] for k in range(blocks)])
        out[:, t, 0] = (own * 2).astype(np.int64).reshape(len(x), wide) @ odd[:wide]
        for k in range(1, probes + 1):
            best = gain.argmax(axis=1)
            out[:, t, k] = out[:, t, 0] + step[best]
            gain[rows, best] = -np.inf
        out[:, t] = (out[:, t] ^ (out[:, t] >> 29)) * odd[wide]
    return out


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES, block: int = BLOCK, seed: int = SEED, blocks: int | None = None, scale: float | None = None, tables: int | None = None
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links is how many other rows have a cosine of ``threshold`` or more and share a cell, component_id the smallest id
    reachable by links, kept whether that is the own id. Equal vectors are one class, whose rows all link. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of another length, and rows
    without an id, whose component is null. Rows that repeat an id count as rows, each with its own vector. Other columns
    aren't looked at. An empty table gives no rows. ``blocks``, ``scale`` and ``tables`` come from the number of classes
    (see ``ladder``); a lower threshold needs more tables.
    """
    double = dict(vectors.dtypes)[vector_col] != "array<float>"
    kind = "<f8" if double else "<f4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for v in batch.column(1):
                v = None if not v.is_valid or v.values.null_count else np.asarray(v.values, dtype=kind)
                held.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["_id", "_vector"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("_vector")).to_pylist()
            keys = [None] * len(raw)
            for size in {len(x) for x in raw}:
                at = [k for k, x in enumerate(raw) if len(x) == size]
                for k, own in zip(at, cells(_unit([raw[k] for k in at], kind), blocks, scale, tables, probes, seed)):
                    keys[k] = own.ravel()
            yield batch.append_column("_cells", pa.array(keys, pa.list_(pa.int64())))

    def block_links(x: np.ndarray, weight: np.ndarray, part: np.ndarray, keys: np.ndarray, cell: int, apart: bool) -> tuple[np.ndarray, ...] | None:
        """(place, count, place of the root) of the members of one block that have links; members come in the order of their nodes."""
        linked = x @ x.T >= threshold
        if apart:  # members of one part are compared elsewhere
            linked &= part[:, None] != part[None, :]
        np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        root, count = np.arange(len(x)), np.zeros(len(x), np.int64)
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
            if (low == root).all():
                break
            root = low
        a, b = np.nonzero(np.triu(linked, 1))
        first, done = np.zeros(len(a), bool), np.zeros(len(a), bool)  # whether no earlier cell has both
        for t in range(tables):
            same = keys[a, t][:, :, None] == keys[b, t][:, None, :]
            least = np.where(same, keys[a, t][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
            some = same.any(axis=(1, 2)) & ~done
            first[some] = least[some] == cell
            done |= some
        np.add.at(count, a[first], weight[b[first]])
        np.add.at(count, b[first], weight[a[first]])
        some = np.flatnonzero(linked.any(axis=1))
        return some, count[some], root[some]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; the last block of a batch waits for the next batch."""

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            block_of = np.stack([np.asarray(rows.column(k), dtype=np.int64) for k in ("_cell", "_one", "_two")])
            ids, tags, weight, part = (np.asarray(rows.column(k)) for k in ("_id", "_tag", "_weight", "_part"))
            raw = rows.column("_vector").to_pylist()
            keys = np.asarray(rows.column("_cells").combine_chunks().flatten()).reshape(len(ids), tables, probes + 1)
            size = np.array([len(x) for x in raw])
            at, x = np.zeros(len(raw), np.int64), {}
            for n in set(size.tolist()):
                own = np.flatnonzero(size == n)
                x[n], at[own] = _unit([raw[k] for k in own], kind), np.arange(len(own))
            cuts = np.flatnonzero(np.concatenate([[True], (block_of[:, 1:] != block_of[:, :-1]).any(axis=0), [True]]))
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                cell, one, two = block_of[:, a].tolist()
                for n in set(size[a:b].tolist()):
                    own = a + np.flatnonzero(size[a:b] == n)
                    if len(own) > 1 and (got := block_links(x[n][at[own]], weight[own], part[own], keys[own], cell, one != two)):
                        node, root = own[got[0]], own[got[2]]
                        found.append((ids[node], tags[node], got[1], ids[root], tags[root]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["_id", "_tag", "_count", "_root_id", "_root_tag"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = [rows.column(k)[-1].as_py() for k in ("_cell", "_one", "_two")]
            begin = rows.num_rows
            for at in range(rows.num_rows - 1, -1, -1):
                if [rows.column(k)[at].as_py() for k in ("_cell", "_one", "_two")] != last:
                    break
                begin = at
            if begin:
                yield from run(rows.slice(0, begin))
            held = rows.slice(begin)
        if held is not None:
            yield from run(held)

    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    packed = cut(rows.mapInArrow(tidy(pack), "_id long, _vector binary"))
    member = cut(tree_merge(packed.where("_id IS NOT NULL AND _vector IS NOT NULL"), ["_vector"], keep="min"))
    # A class is named by its smallest id and a hash of its vector: rows that repeat an id may have several vectors.
    chosen = member.where("_id = _keep").select("_id", F.xxhash64("_vector").alias("_tag"), F.col("_group").alias("_weight"), "_vector").distinct()
    if blocks is None or scale is None or tables is None:
        rung = ladder(chosen.count())
        blocks, scale, tables = (own if given is None else given for given, own in zip((blocks, scale, tables), rung))
    node = ["_id", "_tag"]
    classes = cut(chosen.mapInArrow(tidy(hashed), "_id long, _tag long, _weight long, _vector binary, _cells array<long>"))
    postings = classes.select(*node, F.explode(F.array_distinct("_cells")).alias("_cell"))
    lengths = postings.groupBy("_cell").agg(F.count(F.lit(1)).alias("_length")).where("_length > 1")
    parts = F.ceil(F.col("_length") / block).cast("int")
    dealt = (
        postings.join(lengths, "_cell")
        .select("_cell", *node, parts.alias("_parts"), F.pmod(F.xxhash64(*node, "_cell"), parts).cast("int").alias("_part"))
        .select("_cell", *node, "_part", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_other"), "_parts")
        .select("_cell", *node, "_part", F.least("_part", "_other").alias("_one"), F.greatest("_part", "_other").alias("_two"))
    )
    dealt = dealt.join(classes, node).repartition("_cell", "_one", "_two").sortWithinPartitions("_cell", "_one", "_two", *node)
    found = dealt.mapInArrow(tidy(compare), "_id long, _tag long, _count long, _root_id long, _root_tag long")
    found = cut(found.groupBy(F.struct("_id", "_tag").alias("_node"), F.struct(F.col("_root_id").alias("_id"), F.col("_root_tag").alias("_tag")).alias("_root")).agg(F.sum("_count").alias("_count")))
    links = found.groupBy("_node").agg(F.sum("_count").alias("_links"))
    near = components(found, "_node", "_root").select(F.col("node").alias("_node"), F.col("component._id").alias("_least"))
    of_class = links.join(near, "_node", "full").select("_node", F.coalesce("_links", F.lit(0)).alias("_links"), "_least")
    named = member.withColumn("_node", F.struct(F.col("_keep").alias("_id"), F.xxhash64("_vector").alias("_tag")))
    good = named.join(of_class, "_node", "left").select("_id", (F.coalesce("_links", F.lit(0)) + F.col("_group") - 1).alias("_links"), F.coalesce("_least", "_keep").alias("_of"))
    rest = packed.where("_id IS NULL OR _vector IS NULL").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_of"))
    return good.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_of").alias("component_id"), F.col("_id").eqNullSafe(F.col("_of")).alias("kept"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept; null, zero and non-finite vectors have no links."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs; vectors without a length link with nothing. Right wherever the cells miss no pair.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= {THRESHOLD} * a.norm * b.norm),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON x = vec_id
"""
