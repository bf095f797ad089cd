"""Token packing: documents' token ids are laid into rows of a fixed length by best-fit decreasing.

Each task packs its own documents, `group_tokens` at a time, so packing moves no data between tasks. A document longer
than a row is split losslessly into whole rows and a rest. Pieces are placed from longest to shortest into the row with
the least room that still holds them; a segment tree over amounts of room finds it in O(log row length). A packed row
has its ids as little-endian unsigned 32-bit integers filled up with pad_id, the cumulative lengths of its segments,
and the positions, which start from 0 with each segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X

#: Packed rows sent at once; a row has 8 bytes a token.
BATCH = 500

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """A byte BPE of the vocabulary at path, made once a worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


class Room:
    """A segment tree over amounts of room: how many rows have each, and the least one that is enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Some row with the least room of at least `least`, and that room."""
        i = least + self.size
        count = self.count
        if not count[i]:
            while i & 1 or not count[i + 1]:  # up, until there is something to the right
                i >>= 1
                if not i:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of piece numbers; every length is from 1 to most. Ties go by number."""
    rows: list[list[int]] = []
    tree = Room(most)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = tree.take(n) if n < most else None
        if found is None:
            rows.append([piece])
            row, room = len(rows) - 1, most
        else:
            row, room = found
            rows[row].append(piece)
        if room > n:
            tree.put(room - n, row)
    return rows


def _pack(path: str, pattern: str, length: int, group_tokens: int, pad_id: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        shard, made = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            per_doc = -(-size // length)
            doc = np.repeat(np.arange(len(size)), per_doc)
            nth = np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc]
            begin = nth * length
            lengths = np.minimum(size[doc] - begin, length)
            src = (np.cumsum(size) - size)[doc] + begin
            rows = best_fit_decreasing(lengths, length)
            for lo in range(0, len(rows), BATCH):
                out: list[list] = [[] for _ in range(10)]
                for r, row in enumerate(rows[lo : lo + BATCH], made + lo):
                    n = lengths[row]
                    matrix = np.full(length, pad_id, "<u4")
                    total = int(n.sum())
                    matrix[:total] = flat[X.ranges(src[row], n)]
                    ends = np.cumsum(n)
                    positions = np.zeros(length, "<u4")
                    positions[:total] = np.arange(total) - np.repeat(ends - n, n)
                    data = matrix.tobytes()
                    values = (shard, r, total, len(row), [0, *ends.tolist()], [docs[d] for d in doc[row]], begin[row].tolist(), hashlib.sha256(data).hexdigest(), data if keep else None, positions.tobytes() if keep else None)
                    for to, x in zip(out, values, strict=True):
                        to.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 10 if keep else 8], names=COLUMNS[: 10 if keep else 8])
            made += len(rows)

        for part in X.pieces(batches, "text", 2 << 20):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                got = enc.encode_to_numpy(text, disallowed_special=()) if len(text) < 1 << 22 else np.array(enc.encode_ordinary(text), np.uint32)
                docs.append(doc)
                ids.append(np.array(got, np.uint32))
                held += len(got)
            if held >= group_tokens:
                yield from flush()
                docs, ids, held = [], [], 0
        if held:
            yield from flush()

    return run


COLUMNS = ["shard", "row", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "doc_begins", "ids_sha256", "ids", "positions"]


def token_packing(docs: DataFrame, path: str, pattern: str, length: int = 2048, group_tokens: int = 4_000_000, pad_id: int = 0, keep: bool = True) -> DataFrame:
    """(shard, row, n_tokens, n_segments, cu_seqlens, doc_ids, doc_begins, ids_sha256[, ids, positions]) of packed rows.

    doc_begins are the places in their documents at which the segments begin, so that the segments of a doc_id in that
    order are its ids again. Null and empty texts have no ids and appear in no row; a row given twice is packed twice;
    a null doc_id is packed as such. An empty table gives no rows. Strings of special tokens are ordinary text.
    """
    schema = "shard int, row long, n_tokens long, n_segments int, cu_seqlens array<int>, doc_ids array<long>, doc_begins array<long>, ids_sha256 string" + ", ids binary, positions binary" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(path, pattern, length, group_tokens, pad_id, keep), schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows (with ids and positions) as Parquet, one folder a shard; ids of a shard's rows in order are its matrix."""
    packed.write.mode("overwrite").partitionBy("shard").parquet(path)
