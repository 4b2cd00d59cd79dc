"""Word-piece counts by a longest-match automaton, without building the pieces.

A trie holds the pieces; a node's failure link leads to where matching goes on once the longest piece so far is taken,
and its pop count says how many pieces that takes. A word then costs time linear in its length. All distinct words of a
slice of rows advance together, one byte at a time.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, tidy
from .ngram_join import _slices

#: Bytes of a word beyond which it isn't matched side by side with others.
LONG_WORD = 256

_matchers: dict[str, "Matcher"] = {}


class Matcher:
    """Counts the pieces that greedy longest-match-first gives: a word's first from ``initial``, the others from ``continuing``.

    A word that can't be matched to its end counts as one unknown piece.
    """

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        child: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 goes on
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for text in pieces:
                at = root
                for c in text:
                    at = child[at].setdefault(c, len(child))
                    if at == len(child):
                        child.append({})
                        piece.append(False)
                if text:
                    piece[at] = True
        link, pops = [-1] * len(child), [0] * len(child)
        todo = deque((root, c, v) for root in (0, 1) for c, v in child[root].items())
        while todo:
            up, c, at = todo.popleft()
            if piece[at]:
                link[at], pops[at] = 1, 1
            else:
                to, n = link[up], pops[up]
                while to >= 0 and c not in child[to]:
                    to, n = link[to], n + pops[to]
                if to >= 0:
                    link[at], pops[at] = child[to][c], n
            todo.extend((at, c, v) for c, v in child[at].items())
        steps = sorted((k << 8 | c, v) for k, own in enumerate(child) for c, v in own.items())
        self.step, self.to = np.array([k for k, _ in steps], np.int64), np.array([v for _, v in steps], np.int64)
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        self._go, self._link, self._pops = dict(steps), link, pops  # the same for one word at a time

    def count(self, word: bytes) -> tuple[int, bool]:
        """(pieces, whether unknown) of one word."""
        go, link, pops, state, pieces = self._go, self._link, self._pops, 0, 0
        for byte in word:
            while (to := go.get(state << 8 | byte)) is None:
                pieces, state = pieces + pops[state], link[state]
                if state < 0:
                    return 1, True
            state = to
        while state > 1:
            pieces, state = pieces + pops[state], link[state]
        return (1, True) if state < 0 else (pieces, False)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, whether unknown) of each word; word k is data[bounds[k]:bounds[k + 1]], of bytes."""
        length = np.diff(bounds)
        long = np.flatnonzero(length > LONG_WORD)  # few words go on so far: one by one is faster
        length[long] = 0
        state, count, dead = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), bool)
        order = np.argsort(-length, kind="stable")
        enough = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")  # words longer than k
        for k, n in enumerate(enough.tolist()):
            todo = order[:n]
            todo = todo[~dead[todo]]
            byte = data[bounds[todo] + k].astype(np.int64)
            while len(todo):
                want = state[todo] << 8 | byte
                at = np.minimum(np.searchsorted(self.step, want), len(self.step) - 1) if len(self.step) else np.zeros(len(todo), np.int64)
                found = self.step[at] == want if len(self.step) else np.zeros(len(todo), bool)
                state[todo[found]] = self.to[at[found]]
                todo, byte = todo[~found], byte[~found]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.link[state[todo]]
                lost = state[todo] < 0
                dead[todo[lost]] = True
                todo, byte = todo[~lost], byte[~lost]
        todo = np.flatnonzero(~dead & (state > 1))
        while len(todo):
            count[todo] += self.pops[state[todo]]
            state[todo] = self.link[state[todo]]
            dead[todo[state[todo] < 0]] = True
            todo = todo[state[todo] > 1]
        count[dead] = 1
        for k in long.tolist():
            count[k], dead[k] = self.count(data[bounds[k] : bounds[k + 1]].tobytes())
        return count, dead


def byte_bpe_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """The vocabulary of a byte-level BPE file as word pieces: those with a leading space start a word, those without spaces go on.

    The space is itself a piece, so words are to be given with a space in front.
    """
    from .packing import byte_marks

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = {mark: value for value, mark in enumerate(byte_marks())}
    pieces = [bytes(byte_of[c] for c in x) for x in vocabulary if all(c in byte_of for c in x)]
    return [x for x in pieces if x[:1] == b" " and b" " not in x[1:]], [x for x in pieces if b" " not in x]


def matcher(path: str) -> Matcher:
    if path not in _matchers:
        _matchers[path] = Matcher(*byte_bpe_pieces(path))
    return _matchers[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens, n_unknown.

    Words are runs without ASCII white space; each is matched with a space in front. n_tokens counts an unknown word as
    one. Null, empty and blank texts have none. Rows that repeat an id, null ids and ties are rows like others; other
    columns aren't looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                split = pc.ascii_split_whitespace(pc.fill_null(part.column(1), ""))
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(split.offsets)))
                flat = split.flatten()
                full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
                row, coded = row[full], flat.filter(pa.array(full, pa.bool_())).dictionary_encode()
                spaced = [b" " + x for x in coded.dictionary.cast(pa.binary()).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in spaced])]).astype(np.int64)
                count, unknown = matcher(tokenizer_path).counts(np.frombuffer(b"".join(spaced), np.uint8), bounds)
                index = np.asarray(coded.indices, dtype=np.int64)
                sums = [np.bincount(row, weights=w, minlength=part.num_rows).astype(np.int64) for w in (np.ones(len(row)), count[index], unknown[index])]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], ["_id", "n_words", "n_tokens", "n_unknown"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(run), "_id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("_id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, n_unknown; null and empty texts have none."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
