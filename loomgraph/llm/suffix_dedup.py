"""Suffix-array dedup: byte strings of `least` (200) bytes that start in two places anywhere are found and removed.

1. Every window of `least` bytes names an anchor: of the k-byte strings inside it the one with the lowest hash, the
   leftmost of equals. Equal windows have equal anchors at equal offsets, so a window can only repeat if its anchor
   does. Anchors are counted by hash; texts that are equal as wholes count once, by their class. A task settles itself
   what it meets twice and sends one mark of it, so a passage that a third of all documents share costs a mark a task.
2. Each repeated anchor sends the bytes of its own windows (a context) to the shard of its hash. Of contexts that a task
   has twice all windows repeat: their places are settled there, and the bytes go out once.
3. A shard builds suffix arrays over its distinct contexts: bytes are classified as smaller or larger than what
   follows, leftmost-smaller substrings are sorted and named, the string of names is sorted recursively, and the whole
   array is induced from it bucket by bucket. Common prefixes are computed in text order (permuted), each from the one
   before it. Windows in a run of suffixes with a common prefix of `least` bytes are matched if the run has two places.
   An anchor with very many different contexts is split by longer anchors inside them, up to whole windows.
4. Matched windows are merged into spans per document, and the rest of its bytes is kept.

Numpy runs the induction in waves: all entries of a bucket that are there are scanned at once, which keeps the order of
the one-by-one scan. At deeper levels the alphabet is as large as the text, so that a wave has one entry; the recursion
sorts those strings of names by rounds of ranks of three, to the depth that `least` bytes need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .shared import carried, cut, few, schema, width

U64 = np.uint64
ANCHOR = 40
#: Longer anchors, as shares of a window, that split what a shorter one leaves in one large group; the last are windows.
FINER = (0.5, 0.8, 1)
PLACE_BITS = 28
STRETCH = 8 << 20
CHUNK = 1 << 19
FLUSH = 16 << 20
#: Places that follow from one compared place at most.
RUN = 4096
_POWER = U64(0x9E3779B97F4A7C55)
_BYTES = X.mix64(np.arange(1, 257, dtype=np.uint64) * X.GOLDEN)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(int(_POWER), -1, 1 << 64)
        return np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _POWER)])), np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, U64(inverse))]))


_BLOCK = 1 << 19
_POW, _INV = _powers(_BLOCK + 4096)


def string_hashes(buf: np.ndarray, n: int, k: int) -> np.ndarray:
    """A hash of the k bytes that start at each of 0 .. n - k."""
    out = np.empty(max(n - k + 1, 0), U64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(out), _BLOCK):
            hi = min(lo + _BLOCK, len(out))
            sums = np.zeros(hi - lo + k, U64)
            np.cumsum(_BYTES[buf[lo : hi + k - 1]] * _POW[: hi - lo + k - 1], out=sums[1:])
            out[lo:hi] = X.mix64((sums[k:] - sums[: hi - lo]) * _INV[: hi - lo])
    return out


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i : i + w] for each i with a whole window."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(buf: np.ndarray, off: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash, place, first and last window start of each anchor; places count from the document's start."""
    n = int(off[-1])
    h = string_hashes(buf, n, k)
    if n >= 1 << PLACE_BITS or n < least:
        if n < least:
            return (np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
        raise ValueError(f"a text of {n} bytes; at most {1 << PLACE_BITS} are handled")
    places = np.arange(len(h), dtype=np.uint64)
    key = (h >> U64(PLACE_BITS) << U64(PLACE_BITS)) | places
    at = (window_minimum(key, least - k + 1) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    room = np.maximum(np.diff(off) - least + 1, 0)
    starts = X.ranges(off[:-1], room)
    doc = np.repeat(np.arange(len(room)), room)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    d = doc[first]
    # the least of many hashes is small: mixed again, it spreads over all shards
    return d, X.mix64(h[at[first]]), at[first] - off[d], starts[first] - off[d], starts[last] - off[d]


def anchors_of(buf: np.ndarray, off: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """As `anchors`, whatever the length: in groups of texts of about STRETCH bytes, a longer text in stretches.

    An anchor whose windows reach over the end of a stretch is named twice, for either stretch's windows.
    """
    found, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STRETCH, side="right")) - 1)
        for lo in range(int(off[i]), int(off[j]), STRETCH) if j == i + 1 else [int(off[i])]:
            hi = min(lo + STRETCH + least - 1, int(off[j])) if j == i + 1 else int(off[j])
            own = np.array([0, hi - lo]) if j == i + 1 else off[i : j + 1] - lo
            part = np.zeros(hi - lo + 8, np.uint8)
            part[: hi - lo] = buf[lo:hi]
            d, h, *places = anchors(part, own, least, k)
            shift = lo - off[i] if j == i + 1 else 0
            found.append((d + i, h, *(x + shift for x in places)))
        i = j
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- suffix arrays ---------------------------------------------------------------------------------------------------


def _scatter(places: np.ndarray, text: np.ndarray, sa: np.ndarray, heads: np.ndarray, step: int) -> None:
    """Put places into the buckets of their symbols, in order, from heads on (step 1) or back (step -1)."""
    symbol = text[places]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    count = np.bincount(symbol, minlength=len(heads))
    nth = np.arange(len(symbol)) - (np.cumsum(count) - count)[symbol]
    sa[heads[symbol] + step * nth] = places[order]
    heads += step * count


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix order that follows from `lms`, leftmost-smaller suffixes in their order: larger ones in a pass over the
    buckets upwards, smaller ones in a pass downwards."""
    n = len(text)
    sa = np.full(n, -1, np.int32)
    count = np.bincount(text, minlength=symbols)
    end = np.cumsum(count)
    start = end - count
    by_symbol = text[lms]
    order = np.argsort(by_symbol, kind="stable")
    lms = lms[order]
    lms_end = np.cumsum(np.bincount(by_symbol, minlength=symbols))
    heads = start.copy()
    _scatter(np.array([n - 1], np.int32), text, sa, heads, 1)
    for c in np.flatnonzero(count):
        done = start[c]
        while done < heads[c]:
            part = sa[done : heads[c]]
            done = heads[c]
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _scatter(before, text, sa, heads, 1)
        part = lms[lms_end[c - 1] if c else 0 : lms_end[c]]
        before = part[part > 0] - 1  # what stands before a leftmost-smaller suffix is larger
        if len(before):
            _scatter(before, text, sa, heads, 1)
    larger_end = heads
    tails = end - 1
    for c in np.flatnonzero(count)[::-1]:
        done = end[c] - 1
        while done > tails[c]:
            part = sa[tails[c] + 1 : done + 1][::-1]
            done = tails[c]
            before = part[part > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _scatter(before, text, sa, tails, -1)
        part = sa[start[c] : larger_end[c]][::-1]
        before = part[part > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _scatter(before, text, sa, tails, -1)
    return sa


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length[i] bytes at a[i] and b[i] are equal, eight at a time."""
    words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    same = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        rest = np.minimum(length[live] - done, 8)
        equal = ((words[a[live] + done] ^ words[b[live] + done]) & X._MASKS[rest]) == 0
        same[live[~equal]] = False
        live = live[equal & (rest == 8)]
        done += 8
        live = live[length[live] > done]
    return same


def order_names(names: np.ndarray, kinds: int, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first `depth` names at least."""
    n, rank, known = len(names), names.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while kinds < n and known < depth:
        key = rank * ((kinds + 1) ** 2)
        if n > known:
            key[: n - known] += rank[known:] * (kinds + 1)
        if n > 2 * known:
            key[: n - 2 * known] += rank[2 * known :]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        kinds, known = int(rank[order[-1]]), 3 * known
    return order


def suffix_order(padded: np.ndarray, n: int, least: int) -> np.ndarray:
    """The suffixes of padded[:n] (bytes, at least 8 of padding behind), sorted by their first `least` bytes at least."""
    text = padded[:n]
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.full(n, n - 1)
    where = np.searchsorted(change, np.arange(n))
    has = where < len(change)
    nxt[has] = change[where[has]]
    smaller = np.zeros(n, bool)
    inner = nxt < n - 1
    smaller[inner] = text[nxt[inner]] < text[nxt[inner] + 1]
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough = induce(text, smaller, lms, 256)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = rough[is_lms[rough]]
        nth = np.empty(n, np.int32)
        nth[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms) + 1, n - lms[-1]).astype(np.int64)
        a, b = by_substring[:-1], by_substring[1:]
        la, lb = length[nth[a]], length[nth[b]]
        differs = la != lb
        same = np.flatnonzero(~differs)
        differs[same] = ~_equal(padded, a[same].astype(np.int64), b[same].astype(np.int64), la[same])
        names = np.empty(len(lms), np.int64)
        names[nth[by_substring]] = np.concatenate([[0], np.cumsum(differs)])
        lms = lms[order_names(names, int(differs.sum()) + 1, least // 2 + 1)]
    return induce(text, smaller, lms, 256)


def common_prefixes(padded: np.ndarray, n: int, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text the length, up to `most`, that its suffix has in common with the one before it in sa.

    Where the bytes before both are equal, a place has one less than the place before it; only the other places are
    compared, and the rest follows in text order. A place is compared no further than what follows from it needs: sa is
    in order by the first `most` bytes only, so very many places can have far longer prefixes in common.
    """
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    alone = np.ones(n, bool)
    inner = (place > 0) & (before > 0)
    alone[inner] = padded[place[inner] - 1] != padded[before[inner] - 1]
    alone[np.flatnonzero(~alone)[before[np.flatnonzero(~alone) - 1] != before[np.flatnonzero(~alone)] - 1]] = True
    alone[::RUN] = True
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(alone)
    need = np.diff(np.append(live, n)) + most - 1
    live, need = live[before[live] >= 0], need[before[live] >= 0]
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    room = np.minimum(n - np.maximum(live, before[live]), need)
    done = 0
    while len(live):
        x = words[live + done] ^ words[before[live] + done]
        low = x & (~x + U64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - U64(1)).astype(np.int64) // 8)
        got = np.minimum(done + equal, room)
        out[live] = got
        keep = (equal == 8) & (room > done + 8)
        live, room = live[keep], room[keep]
        done += 8
    source = np.maximum.accumulate(np.where(alone, place, 0))
    return np.minimum(np.maximum(out[source] + source - place, 0), most)


def repeated_windows(data: np.ndarray, off: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """For contexts data[off[i] : off[i + 1]], whose first length - least + 1 places start windows: which places start
    one that `weight` places have at least twice. Eight bytes of padding stand behind."""
    n = int(off[-1])
    sa = suffix_order(data, n, least)
    plcp = common_prefixes(data, n, sa, least)
    room = np.diff(off) - least + 1
    at = X.ranges(off[:-1], room)
    w = np.zeros(n, np.int64)
    w[at] = np.repeat(weight, room)
    run = np.cumsum(plcp[sa] < least) - 1
    total = np.bincount(run, w[sa])
    out = np.zeros(n, bool)
    out[sa] = total[run] >= 2
    valid = np.zeros(n, bool)
    valid[at] = True
    return out & valid


def groups_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal keys."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(key))


def repeated_in_groups(data: np.ndarray, at: np.ndarray, size: np.ndarray, weight: np.ndarray, key: np.ndarray, least: int, level: int = 0, chunk: int = CHUNK) -> np.ndarray:
    """For contexts data[at : at + size] in the order of their keys: which of their bytes, one context after another,
    start a window that places under one key have at least twice. Groups of up to two chunks are sorted as they are."""
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(off[-1]), bool)
    first, end = groups_of(key)
    last_level = level == len(FINER)  # keys are those of whole windows: a group's contexts are equal
    todo, held = [], 0

    def bytes_of(members: np.ndarray) -> np.ndarray:
        return np.concatenate([data[X.ranges(at[members], size[members])], np.zeros(16, np.uint8)])

    def solve(members: np.ndarray) -> None:
        own = np.concatenate([[0], np.cumsum(size[members])])
        out[X.ranges(off[members], size[members])] = repeated_windows(bytes_of(members), own, weight[members], least)

    def everything(members: np.ndarray) -> None:
        out[X.ranges(off[members], size[members] - least + 1)] = True

    def refine(members: np.ndarray) -> None:
        own = np.concatenate([[0], np.cumsum(size[members])])
        part = bytes_of(members)
        d, h, _, begin, final = anchors_of(part, own, least, int(FINER[level] * least))
        order = np.argsort(h, kind="stable")
        lo, hi = groups_of(h[order])
        order = order[np.repeat((hi - lo > 1) | (weight[members][d[order[lo]]] > 1), hi - lo)]
        inner, length = own[d[order]] + begin[order], (final - begin)[order] + least
        hit = repeated_in_groups(part, inner, length, weight[members][d[order]], h[order], least, level + 1, chunk)
        out[int(off[members[0]]) + X.ranges(inner, length)[hit]] = True

    alone = np.flatnonzero(end - first == 1)
    everything(first[alone][weight[first[alone]] >= 2])
    for g in np.flatnonzero(end - first > 1).tolist():
        members = np.arange(first[g], end[g])
        total = int(off[end[g]] - off[first[g]])
        if last_level:
            everything(members)
        elif total > 2 * chunk:
            refine(members)
        else:
            todo.append(members)
            held += total
            if held >= chunk:
                solve(np.concatenate(todo))
                todo, held = [], 0
    if todo:
        solve(np.concatenate(todo))
    return out


# -- Spark steps -----------------------------------------------------------------------------------------------------


def _parts(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _rows(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())], names=list(columns))


ANCHOR_ROWS = {"part": pa.int32(), "known": pa.bool_(), "hashes": pa.binary(), "classes": pa.binary(), "places": pa.binary()}
CONTEXT_ROWS = {"part": pa.int32(), "known": pa.bool_(), "keys": pa.binary(), "names": pa.binary(), "sizes": pa.binary(), "data": pa.binary(), "classes": pa.binary(), "begins": pa.binary()}
#: Entries that a row of settled places has at most.
SETTLED = 50_000


def _find_anchors(least: int, k: int, parts: int):
    """(cls, text) -> packed anchors: for each part of the hashes those that the task has once, and a mark (place -1) for
    those that it has several times; and the latter themselves, known to repeat, dealt out evenly.

    A place holds where its windows begin and end too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            h, c, p = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, c, p = h[order], c[order], p[order]
            first, end = groups_of(h)
            several = end - first > 1
            known = np.repeat(several, end - first)
            rows = [(int(_parts(X.mix64(x[1][:1].view(U64)), parts)[0]), True, *(y.tobytes() for y in x)) for i in range(0, int(known.sum()), SETTLED) for x in [tuple(y[known][i : i + SETTLED] for y in (h, c, p))]]
            c[first[several]], p[first[several]] = 0, -1
            h, c, p = h[first], c[first], p[first]
            part = _parts(h, parts)
            rows += [(int(part[a]), False, *(x[a:b].tobytes() for x in (h, c, p))) for a, b in zip(*groups_of(part), strict=True)]
            yield _rows(ANCHOR_ROWS, rows)

        for piece in X.pieces(batches, "text", 2 << 20):
            cls = piece.column("cls").to_numpy()
            _, first = np.unique(cls, return_index=True)
            first = np.sort(first)
            first = first[~np.isin(cls[first], seen)]
            seen = np.union1d(seen, cls[first])
            if not len(first):
                continue
            buf, off = X.text_buffer(piece.column("text").take(pa.array(first)))
            d, h, place, lo, hi = anchors_of(buf, off, least, k)
            held.append((h, cls[first][d], (place << 16) | ((place - lo) << 8) | (place - hi)))
            total += len(h)
            if total >= 1_000_000:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed anchors of a part -> (cls, place, hash) of those whose hash two places have."""
    h, c, p = [], [], []
    name = ["cls", "place", "hash"]
    for b in batches:
        known = b.column("known").to_pylist()
        for r in range(len(b)):
            x, y, z = (np.frombuffer(b.column(i)[r].as_buffer(), kind) for i, kind in ((2, U64), (3, np.int64), (4, np.int64)))
            if known[r]:
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(z), pa.array(x.view(np.int64))], names=name)
            else:
                for out, a in ((h, x), (c, y), (p, z)):
                    out.append(a)
    if not h:
        return
    h, c, p = np.concatenate(h), np.concatenate(c), np.concatenate(p)
    order = np.argsort(h, kind="stable")
    first, end = groups_of(h[order])
    order = order[np.repeat(end - first > 1, end - first)]
    h, c, p = h[order], c[order], p[order]
    order = np.lexsort((p, c, h))
    h, c, p = h[order], c[order], p[order]
    fresh = np.ones(len(h), bool)  # the same place of a class may come from several tasks: it is one place
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    mark = p < 0
    first, end = groups_of(h)
    if not len(h):
        return
    twice = (np.add.reduceat((fresh & ~mark).astype(np.int64), first) + 2 * np.logical_or.reduceat(mark, first)) > 1
    keep = fresh & ~mark & np.repeat(twice, end - first)
    h, c, p = h[keep], c[keep], p[keep]
    for i in range(0, len(h), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[s]), pa.array(p[s]), pa.array(h[s].view(np.int64))], names=name)


def _contexts(least: int, parts: int):
    """(cls, many, text, found) -> packed contexts: for each part of the anchors the distinct ones with their place, begin
    -1 for those that the task has several times; and the places of the latter, known to repeat, dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            data = np.concatenate([*(x[0] for x in held), np.zeros(8, np.uint8)])
            key, cls, begin, size = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            at = np.concatenate([x[5] + b for x, b in zip(held, base, strict=False)])
            name = X.span_hashes(data, at, at + size)
            order = np.lexsort((size, name, key))
            key, cls, begin, size, at, name = (x[order] for x in (key, cls, begin, size, at, name))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (size[1:] != size[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(key)))
            several = (count > 1) | (begin[first] < 0)
            settled = np.flatnonzero(np.repeat(several, count) & (begin >= 0))
            rows = []
            for i in range(0, len(settled), SETTLED):
                u = settled[i : i + SETTLED]
                rows.append((int(_parts(X.mix64(cls[u[:1]].view(U64)), parts)[0]), True, None, None, size[u].astype(np.int32).tobytes(), None, cls[u].tobytes(), begin[u].tobytes()))
            begin = np.where(several, -1, begin[first])
            key, name, size, at, cls = (x[first] for x in (key, name, size, at, cls))
            for a, b in zip(*groups_of(_parts(key, parts)), strict=True):
                values = (key[a:b], name[a:b], size[a:b].astype(np.int32), data[X.ranges(at[a:b], size[a:b])], cls[a:b], begin[a:b])
                rows.append((int(_parts(key[a : a + 1], parts)[0]), False, *(x.tobytes() for x in values)))
            yield _rows(CONTEXT_ROWS, rows)

        for piece in X.pieces(batches, "text", 2 << 20):
            cls, many = piece.column("cls").to_numpy(), piece.column("many").to_numpy(zero_copy_only=False)
            buf, off = X.text_buffer(piece.column("text"))
            found = piece.column("found")
            lists = found.offsets.to_numpy().astype(np.int64)
            flat = found.values
            place, key = flat.field("place").to_numpy(), flat.field("hash").to_numpy().view(U64)
            count = np.diff(lists)
            for i in range(len(cls)):  # a row given twice counts once
                if int(cls[i]) in seen:
                    count[i] = 0
                seen.add(int(cls[i]))
            every = X.ranges(lists[:-1], count)
            owner = np.repeat(np.arange(len(cls)), count)
            most = 4 * FLUSH // (3 * least)  # contexts of a long text go out in several portions
            for i in range(0, len(every), most):
                pick, doc = every[i : i + most], owner[i : i + most]
                lo = (place[pick] >> 16) - ((place[pick] >> 8) & 255)
                size = ((place[pick] >> 8) & 255) - (place[pick] & 255) + least
                # a class with copies is removed as a whole: its place counts, but needs no span
                held.append((buf[X.ranges(off[doc] + lo, size)], key[pick], cls[doc], np.where(many[doc], -1, lo), size, np.cumsum(size) - size))
                total += int(size.sum())
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    return run


def _shard(least: int):
    """Packed contexts of a shard -> (cls, begin, end) of matched spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"keys": U64, "names": U64, "sizes": np.int32, "data": np.uint8, "classes": np.int64, "begins": np.int64}
        cols: dict[str, list[np.ndarray]] = {x: [] for x in kinds}
        spans = lambda c, b, e: pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(e)], names=["cls", "begin", "end"])
        for b in batches:
            known = b.column("known").to_pylist()
            for r in range(len(b)):
                got = {x: np.frombuffer(b.column(x)[r].as_buffer(), kind) for x, kind in kinds.items() if not known[r] or x in ("sizes", "classes", "begins")}
                if known[r]:
                    yield spans(got["classes"], got["begins"], got["begins"] + got["sizes"])
                else:
                    for x in kinds:
                        cols[x].append(got[x])
        if not cols["keys"]:
            return
        key, name, size, data, cls, begin = (np.concatenate(cols.pop(x)) for x in kinds)
        size = size.astype(np.int64)
        at = np.cumsum(size) - size
        order = np.lexsort((size, name, key))
        k, m, s = key[order], name[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        bound = np.append(first, len(order))  # the entries of each distinct context, in `order`
        weight = np.minimum(np.add.reduceat(np.where(begin[order] < 0, 2, 1), first), 2)
        key, size, at = k[first], s[first], at[order[first]]
        del k, m, s, name
        hit = np.flatnonzero(repeated_in_groups(data, at, size, weight, key, least))
        if not len(hit):
            return
        off = np.concatenate([[0], np.cumsum(size)])
        c = np.searchsorted(off, hit, side="right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > least) | (c[1:] != c[:-1])
        last = np.append(new[1:], True)
        which, b, e = c[new], (hit - off[c])[new], (hit - off[c])[last] + least
        times = np.diff(bound)[which]
        refs = order[X.ranges(bound[which], times)]
        b, e, ok = np.repeat(b, times), np.repeat(e, times), begin[refs] >= 0
        refs = refs[ok]
        yield spans(cls[refs], begin[refs] + b[ok], begin[refs] + e[ok])

    return run


def _cut_out(keep_text: bool, as_text: bool):
    """(doc_id, text, whole, found) -> what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in X.pieces(batches, "text", 4 << 20):
            buf, off = X.text_buffer(piece.column("text"))
            whole = piece.column("whole").to_pylist()
            found = piece.column("found").to_pylist()
            rows: list[list] = [[], [], [], [], [], []]
            for i in range(len(whole)):
                text = buf[off[i] : off[i + 1]].tobytes()
                spans: list[list[int]] = []
                if whole[i]:
                    spans = [[0, len(text)]]
                else:
                    for x in sorted(found[i] or [], key=lambda x: (x["begin"], x["end"])):
                        if spans and x["begin"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x["end"])
                        else:
                            spans.append([x["begin"], x["end"]])
                kept, last = [], 0
                for b, e in spans:
                    kept.append(text[last:b])
                    last = e
                kept.append(text[last:])
                left = b"".join(kept)
                values = (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"begin": b, "end": e} for b, e in spans], left)
                for out, x in zip(rows, values, strict=True):
                    out.append(x)
            if as_text:
                rows[5] = [x.decode("utf-8", errors="ignore") for x in rows[5]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string() if as_text else pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 if keep_text else 4]
            extra = [x for x in piece.schema.names if x == "carried"]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, k) for x, k in list(zip(rows, kinds, strict=True))[: len(names)]), *(piece.column(x) for x in extra)], names=["doc_id", *names, *extra])

    return run


def suffix_dedup(docs: DataFrame, least: int = 200, keep: bool = True, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept, carried]) for every row of docs (doc_id, text).

    A byte is removed if a string of `least` bytes covers it that also starts at another place: in another row or in
    the same one, overlaps included, judged on the texts as given. spans are the removed byte ranges, kept the rest
    (bytes, as a cut may part a character; with as_text a string without such parts). Null counts as empty; rows with
    null doc_id take part; rows given twice are copies of each other; further columns are ignored, but those that
    `carry` names come back in a struct (see shared.restored). Equal texts are found by a 64-bit hash; different texts
    that share one, which a second hash tells, are left as they are.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried(carry)).withColumn("cls", F.xxhash64("text"))
    long = source.where(F.octet_length("text") >= least)
    second = F.xxhash64(F.lit(1), "text")
    per_class = long.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.max(F.octet_length("text")).alias("size"), F.min(second).alias("a"), F.max(second).alias("b"))
    per_class = cut(per_class.where("a = b").drop("a", "b"))
    size = per_class.agg(F.sum("size")).first()[0] or 0
    parts, files = width(spark, size, 256 << 20), few(spark, size)
    packed = long.select("cls", "text").mapInArrow(_find_anchors(least, ANCHOR, parts), "part int, known boolean, hashes binary, classes binary, places binary")
    repeated = packed.repartition(parts, "part").mapInArrow(_repeated, "cls long, place long, hash long")
    found = repeated.groupBy("cls").agg(F.collect_set(F.struct("place", "hash")).alias("found"))
    found = cut(found.join(per_class, "cls").select("cls", "rep", (F.col("n") > 1).alias("many"), "found").coalesce(files))
    here = source.alias("s").join(found.alias("f").hint("shuffle_hash"), (F.col("s.cls") == F.col("f.cls")) & F.col("s.doc_id").eqNullSafe(F.col("f.rep")))
    contexts = here.select("f.cls", "f.many", "s.text", "f.found").mapInArrow(_contexts(least, parts), "part int, known boolean, keys binary, names binary, sizes binary, data binary, classes binary, begins binary")
    matched = contexts.repartition(parts, "part").mapInArrow(_shard(least), "cls long, begin long, end long")
    spans = matched.groupBy("cls").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    single = per_class.where("n = 1").join(spans, "cls").select("cls", F.col("rep").alias("doc_id"), F.lit(False).alias("whole"), "found")
    spans_type = "array<struct<begin: bigint, end: bigint>>"
    copies = source.select("doc_id", "cls").join(per_class.where("n > 1").select("cls"), "cls").distinct().select("cls", "doc_id", F.lit(True).alias("whole"), F.lit(None).cast(spans_type).alias("found"))
    decided = cut(single.unionByName(copies).coalesce(files))
    joined = source.alias("s").join(decided.alias("d").hint("shuffle_hash"), (F.col("s.cls") == F.col("d.cls")) & F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")), "left").select("s.doc_id", "s.text", F.coalesce("d.whole", F.lit(False)).alias("whole"), "d.found", *[F.col("s.carried")] * bool(carry))
    own = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", spans array<struct<begin: long, end: long>>, kept {'string' if as_text else 'binary'}" * keep
    return joined.mapInArrow(_cut_out(keep, as_text), schema(own, docs, carry))
