"""Numpy text primitives shared by the operators: Arrow string buffers as byte arrays, word spans, hashes.

Everything works on whole record batches: a batch of texts is one uint8 buffer and its offsets, so no Python
object is made for a word. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64; the result is a new array."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets into them; the bytes end with 8 zero bytes of padding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    lo, hi = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    out = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        out[: hi - lo] = np.frombuffer(data, np.uint8)[lo:hi]
    return out, at - lo if len(at) else np.zeros(1, np.int64)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back: workers live on, and what they hold adds up beside the executor's own."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most `most` bytes together; one longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        lo, n = 0, len(lengths)
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
        release()


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each text, and word offsets per text (n + 1)."""
    n = int(off[-1])
    m = is_word[buf[:n]]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = off[1:-1]
    at = inner[(inner > 0) & (inner < n)]
    first[at] = m[at]
    last[at - 1] = m[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by rounds of eight bytes over all spans that still have bytes left."""
    words = np.ndarray(shape=(max(len(buf) - 7, 1),), dtype="<u8", buffer=buf, strides=(1,)) if len(buf) >= 8 else np.zeros(1, U64)
    left = ends - starts
    with np.errstate(over="ignore"):
        h = mix64(left.astype(U64) * GOLDEN)
        take = words[starts] & _MASKS[np.minimum(left, 8)] if len(starts) else np.zeros(0, U64)
        h = mix64((h ^ take) * GOLDEN)
        live = np.flatnonzero(left > 8)
        done = 8
        while len(live):
            rest = left[live] - done
            chunk = words[starts[live] + done] & _MASKS[np.minimum(rest, 8)]
            h[live] = mix64((h[live] ^ chunk) * GOLDEN + U64(done))
            live = live[rest > 8]
            done += 8
    return h


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over lower-cased bytes: digits, a-z and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
