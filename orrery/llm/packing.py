"""Cost-balanced packing of documents into token sequences.

A document's cost in a sequence is ``linear * tokens + quadratic * tokens**2`` (dense layers and attention within the
document). Whole blocks of a long document become sequences of their own; what is left of each document goes, by
descending cost, to the sequence that costs least and still has room, and is cut where that room ends. The sequences
of a group hold exactly the group's tokens: so many full ones, and one for each power of two in the rest, so nothing
is padded. A group is a few megabytes of neighbouring rows, so packing needs no shuffle and bounded memory.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, tidy

SEQUENCE_TOKENS = 1024
GROUP_BYTES = 4 << 20
END_OF_DOCUMENT = 0
#: Tokens of attention that cost as much as the linear part of one token.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
# Fixed value: how byte-level BPE files of this kind split text.
PRETOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""

_encoders: dict[str, "ByteEncoder"] = {}


class ByteEncoder:
    """The ids that a byte-level BPE file of the tokenizers library gives, by a faster encoder with the same merges.

    The file's ids rank its merges, so its vocabulary is all that tiktoken needs. A text that the pattern engine gives
    up on goes to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {mark: value for value, mark in enumerate(byte_marks())}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items()}
        self.path, self.fast, self.plain = path, tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}), None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the engine's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.encode_plain(text)

    def encode_plain(self, text: str) -> np.ndarray:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
            self.plain.encode_special_tokens = True
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_marks() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def capacities(tokens: int, size: int) -> list[int]:
    """Sequences that hold exactly so many tokens: full ones, then descending powers of two."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], size: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents and sequences count from 0."""
    cost = lambda n: linear * n + quadratic * n * n
    pieces, sequence, rest = [], 0, []
    for k, n in enumerate(lengths):
        whole = n // size * size
        for at in range(0, whole, size):
            pieces.append((k, at, size, sequence, 0))
            sequence += 1
        if n > whole:
            rest.append((n - whole, k, whole))
    room = capacities(sum(n for n, _, _ in rest), size)
    # A short sequence starts as if the room that it lacks were taken, so that costs compare.
    heap = [(cost(size - most), k, most) for k, most in enumerate(room)]
    heapq.heapify(heap)
    for n, k, at in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            spent, where, left = heapq.heappop(heap)
            part = min(n, left)
            pieces.append((k, at, part, sequence + where, room[where] - left))
            at, n = at + part, n - part
            if left > part:
                heapq.heappush(heap, (spent + cost(part), where, left - part))
    return pieces


def _groups(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
    begin, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, group_bytes: int = GROUP_BYTES, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids (the piece's tokens).

    A document's tokens are its ids by the tokenizer without special tokens, then END_OF_DOCUMENT; null text counts as
    empty and so has one token. Rows are packed as they come, repeated ids and null ids included; other columns aren't
    looked at. An empty table gives no rows. Sequence ids are unique; which rows share a sequence depends on how the
    input is partitioned. Every sequence is full or a power of two long. ids_crc32 is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, encode = TaskContext.get().partitionId() << 36, encoder(tokenizer_path).encode
        end = np.array([END_OF_DOCUMENT], np.uint32)
        for batch in batches:
            for part in _groups(batch, group_bytes):
                ids = [np.concatenate([encode(x.as_py() or ""), end]) for x in part.column(1)]
                pieces = pack([len(x) for x in ids], size, linear, quadratic)
                document, start, length, number, offset = (np.array(x, np.int64) for x in zip(*pieces))
                owned = [ids[k][at : at + n] for k, at, n, _, _ in pieces]
                crc = pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in owned], pa.int64())
                total = np.array([len(x) for x in ids], np.int64)[document]
                out = [part.column(0).take(pa.array(document)), pa.array(start), pa.array(length), crc, pa.array(total), pa.array(number + sequence), pa.array(offset)]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(owned).view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)
                sequence += int(number.max()) + 1

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(run), ", ".join(f"{k} long" for k in names) + ", ids array<int>" * with_ids).withColumnRenamed("_id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; null and empty texts are their end token alone."""
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
