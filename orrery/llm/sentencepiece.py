"""SentencePiece encoding and decoding, one traversal for all distinct words of a slice.

Spaces become marks, and a word is a run of marks with what follows. Distinct words are sorted, which is their trie in
depth-first order: a word keeps the forward states of the prefix that it shares with the word before and computes the
others only.

For a unigram model the forward state is the best score of a prefix with its last piece (Viterbi). For a BPE model
scores are merge ranks, and the segmentation of the highest score is not what merging gives, so Viterbi can't give right
results; the traversal stays, but the state is the last piece of the prefix's merge segmentation. That piece is the one
whose boundary with the prefix before it merging would respect, which two pieces alone decide.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, tidy
from .ngram_join import _slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "
CACHED_WORDS = 300_000

_models: dict[tuple[str, int | None], "Model"] = {}


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """A model file's pieces, and the segmentation of words by it: as the file says, or as ``kind`` does (UNIGRAM takes any file's scores)."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for field, value in _message(data):
            if field == 1:
                own = dict(_message(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own.get(2, b"\0" * 4))[0])
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normalizer = dict(_message(value))
        self.kind = kind or trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined pieces are not supported")
        if normalizer.get(2):
            raise ValueError("only models without a normalisation table are supported")
        self.dummy, self.strip, self.escape = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.id = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == BYTE}
        self.floor = min((self.scores[k] for k in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        #: Whether words can be segmented one by one: no piece goes on over a mark.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        self._surface = [self._decoded(k) for k in range(len(self.pieces))]
        self._is_byte = np.array([k == BYTE for k in self.kinds])
        self._known: dict[str, bytes] = {}
        self._valid: dict[tuple[str, str], bool] = {}
        if self.kind == BPE:
            by_rank = sorted(self.id, key=lambda p: (-self.scores[self.id[p]], self.id[p]))
            self.rank = {p: k for k, p in enumerate(by_rank)}
            self.halves: dict[str, tuple[str, str]] = {}
            for p in by_rank:
                if len(p) > 1:
                    got = self._merged(p, self.rank[p])
                    if len(got) == 2:
                        self.halves[p] = (got[0], got[1])
        # A trie of the pieces read from their ends, to find those that end at a place.
        self.ends: dict = {}
        for p in self.id:
            if self.kind == UNIGRAM or len(p) == 1 or p in self.halves:
                node = self.ends
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p

    # Normalisation and words

    def normalise(self, text: str) -> str:
        if self.strip:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def words(self, marked: str) -> list[str]:
        return _WORDS.findall(marked) if self.by_word else [marked] if marked else []

    # BPE

    def _merged(self, text: str, before: int) -> list[str]:
        """What merges of a rank under ``before`` make of the text: the best first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, before), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= before:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between these two pieces.

        The merges that made them are undone, the latest first. If the parts that then touch make a piece of a rank
        under that of the merge just undone, they would have been merged before it.
        """
        known = self._valid.get((left, right))
        if known is not None:
            return known
        a, b, limit, out = left, right, len(self.rank), True
        while out:
            if self.rank.get(a + b, limit) < limit:
                out = False
                break
            one = self.rank[a] if a in self.halves else -1
            two = self.rank[b] if b in self.halves else -1
            if one < 0 and two < 0:
                break
            if one > two:  # of equal merges the left one comes first
                limit, a = one, self.halves[a][1]
            else:
                limit, b = two + 1, self.halves[b][0]
        self._valid[left, right] = out
        return out

    # Segmentation

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            k = self.id.get(p)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out.extend(self.bytes[x] for x in p.encode())
            else:
                out.append(self.unknown)
        return out

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words; a character that no piece holds is a piece."""
        before, last, score = "", [""], [0.0]
        bpe, ends, apart, scores, ids, floor = self.kind == BPE, self.ends, self.apart, self.scores, self.id, self.floor
        for word in words:
            common = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], score[common + 1 :]
            for i in range(common + 1, len(word) + 1):
                node, found, j = ends, [], i
                while j and (node := node.get(word[j - 1])) is not None:
                    j -= 1
                    if "" in node:
                        found.append(node[""])
                char = word[i - 1]
                if not found or len(found[0]) > 1:
                    found.insert(0, char)
                if bpe:
                    for p in reversed(found):
                        at = i - len(p)
                        if not at or apart(last[at], p):
                            last.append(p)
                            break
                else:
                    best, of = None, char
                    for p in reversed(found):
                        own = score[i - len(p)] + (scores[ids[p]] if p in ids else floor)
                        if best is None or own > best:
                            best, of = own, p
                    last.append(of)
                    score.append(best)
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            before = word
            yield word, pieces[::-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(self.normalise(x)) for x in texts]
        if len(self._known) > CACHED_WORDS:
            self._known.clear()
        if len(self._valid) > 4 * CACHED_WORDS:
            self._valid.clear()
        fresh = sorted({w for own in split for w in own} - self._known.keys())
        for word, pieces in self.segment(fresh):
            self._known[word] = np.array(self._ids(pieces), "<i4").tobytes()
        known = self._known
        out = [np.frombuffer(b"".join([known[w] for w in own]), "<i4") for own in split]
        if not self.byte_fallback:  # a run of unknown characters is one piece
            out = [x[~((x == self.unknown) & (np.roll(x, 1) == self.unknown) & (np.arange(len(x)) > 0))] for x in out]
        return out

    def _decoded(self, k: int) -> bytes:
        kind, piece = self.kinds[k], self.pieces[k]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else UNKNOWN_SURFACE.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text; byte pieces that aren't UTF-8 give a replacement character each."""
        text = b"".join([self._surface[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model(path: str, kind: int | None = None) -> Model:
    if (path, kind) not in _models:
        with open(path, "rb") as file:
            _models[path, kind] = Model(file.read(), kind)
    return _models[path, kind]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the ids of the text; null and empty text have none.

    Other columns stay; one named out_col is replaced. Repeated rows are encoded each; very long texts cost in proportion
    to their distinct words. An empty table gives no rows.
    """

    @F.pandas_udf("array<int>")
    def run(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        return pd.Series([x for part in _slices(batch, 0) for x in model(model_path).encode(part.column(0).to_pylist())])

    return bounded(docs).withColumn(out_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col``, the text that the ids give; null ids give null, no ids empty text.

    Other columns stay; one named out_col is replaced. An id outside the vocabulary is an error. An empty table gives no rows.
    """

    @F.pandas_udf("string")
    def run(ids):
        return ids.map(lambda x: None if x is None else model(model_path).decode(x))

    return bounded(tokens).withColumn(out_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: int | None = None) -> DataFrame:
    """One row per document: id, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the decoded text), same (whether that is the text).

    Null text counts as empty. Rows that repeat an id and null ids are rows like others; other columns aren't looked at. An
    empty table gives no rows.
    """
    import hashlib
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path, kind)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = own.encode(texts)
                decoded = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array([a == b for a, b in zip(texts, decoded)])],
                    ["_id", "n_ids", "ids_crc32", "decoded_sha256", "same"],
                )

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(run), "_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean").withColumnRenamed("_id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32, decoded_sha256, same; null and empty texts have no ids."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the file's pieces and scores as a unigram model: the segmentation of the highest score, by Viterbi proper."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), kind=UNIGRAM)
