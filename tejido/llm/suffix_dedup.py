"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id is removed; strings are
judged on the input and never cross documents. The suffixes that matter are those with at least `length` bytes left
(below: windows), compared on that many bytes.

1. Buckets. A window belongs to the bucket of its anchor, the k-gram in it with the smallest hash (leftmost if equal), so
   equal windows meet in one bucket, at the same distance from their anchor. Neighbouring windows with one anchor travel
   as one slice of text. A first pass notes, for each anchor, whether more than one document has it; only such anchors'
   suffixes are sorted at all, since a repeated window has a repeated anchor. This first pass and the answers of its
   buckets (bit filters, whose false hits only cost work) go through the driver for one range of buckets at a time.
2. Suffix buckets, one at a time. A bucket's slices are laid out with their anchors at multiples of the cover's period.
   The cover's sample suffixes are sorted once, with the lengths that neighbours have in common; a window is then sorted
   by its few bytes up to the next sample and that sample's rank, which settles ties of any length without reading on.
   Memory is bounded by the block of slices that is sorted.
3. The smallest doc_id of each class of equal windows decides which windows go; runs of those become byte spans, which
   are gathered for each document and cut out of its text.

Within a worker's batch equal slices are sent once, for their smallest document; the others are settled on the spot. Equal
slices of one document at even distances, as a run of one character or a repeated line gives them, are one slice with a
count. An anchor with very many slices has its windows dealt by their own content, each equal window once for each batch,
so no bucket grows with a passage that many documents share. Hashes only bring slices together: what is taken for equal is
compared byte by byte. Long texts are worked on in pieces of SEGMENT bytes, whatever their length.

Rows are numbered once, in a table that is written with their compressed texts; all passes read that table, so numbers do
not depend on how a scan is split.

Null text: as empty. Texts shorter than `length` are kept whole. Rows with equal doc_id don't remove from each other, and
each row gives one result; a null doc_id counts as the largest. An empty table gives no rows. Further columns are ignored here (see `keep`).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, trim, written

LENGTH, GRAM = 50, 24
#: A difference cover modulo its period (every difference occurs between two members), and odd multipliers.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are worked on at once.
SEGMENT = 500_000
#: Anchors per request batch, slices per sorted block and per batch, filter bytes at the driver, slices of a crowded anchor.
REQUESTS, BLOCK, SLICES, FILTER_BYTES, CROWDED = 1_000_000, 30_000, 200_000, 64 << 20, 20_000
#: Text bytes whose documents and spans are put together in one task.
GATHER = 24 << 20
ROW = "kind int, bucket int, uid long, doc_id long, data binary"
NAMES = ["kind", "bucket", "uid", "doc_id", "data"]
SPAN, SLICE, TEXT = 0, 1, 2
LAST_ID = (1 << 63) - 1

_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power or len(_power[0]) < n:
        size = max(n, SEGMENT + 2 * LENGTH)
        _power[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _power[0][:n], _power[1][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string, from running sums of bytes times powers (arithmetic modulo 2**64)."""
    n = len(data) - k + 1
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    h = (sums[k:] - sums[:-k]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, a
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, to tell spans with one anchor hash apart."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[start + size] - sums[start]) * down[start]
    h ^= h >> np.uint64(31)
    return h * np.uint64(MIX) + size.astype(np.uint64)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans end to end."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans from a and from b on, of equal sizes above zero, differ; some bytes at a time."""
    out = np.zeros(len(a), bool)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(size), np.arange(SEGMENT, int(size.sum()), SEGMENT)), [len(a)]])) if len(a) else []
    for i, j in zip(cuts, cuts[1:]):
        unlike = gather(data, a[i:j], size[i:j]) != gather(data, b[i:j], size[i:j])
        out[i:j] = np.logical_or.reduceat(unlike, np.cumsum(size[i:j]) - size[i:j])
    return out


def slices(group: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor, over a few texts: (text number, first window, windows, anchor's place in the slice, anchor hash)."""
    pieces, base, number, at = [], [], [], 0
    for i, t in enumerate(group):
        for s in range(0, max(len(t) - length + 1, 0), SEGMENT):
            pieces.append(t[s : s + SEGMENT + length - 1])
            base.append(s)
            number.append(i)
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none, none.astype(np.uint64))]
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end]) <= SEGMENT):
            size += len(pieces[end])
            end += 1
        data = np.frombuffer(b"".join(pieces[at:end]), np.uint8)
        h = gram_hashes(data, gram)
        keys = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces[at:end]])
        starts = np.concatenate([[0], ends[:-1]])
        piece = np.repeat(np.arange(end - at), ends - starts)[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= ends[piece]
        first = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        where = np.flatnonzero(first)
        stop = np.minimum(np.concatenate([where[1:], [len(anchor)]]), ends[piece[where]] - length + 1)
        p = piece[where]
        out.append((np.array(number[at:end])[p], where - starts[p] + np.array(base[at:end])[p], stop - where, anchor[where] - where, h[anchor[where]]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(*columns: np.ndarray) -> bytes:
    """Equal-length 64-bit columns, byte planes together so that what repeats in them compresses."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(columns[0])) + planes)


def _unpacked(blob: bytes, columns: int, kind=np.int64) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack("<q", data[:8])[0]
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).reshape(-1).view(kind) for p in planes]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], NAMES)


def _reduce(h: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray):
    order = np.argsort(h)
    h = h[order]
    if not len(h):
        return h, low, high, n
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Three bit places for each hash in a filter of `size` bits."""
    return [((h * np.uint64(m)) >> np.uint64(20)) % np.uint64(size) for m in (BASE, MIX, 0xA0761D6478BD642F)]


class Filter:
    """Bit filters of a range of buckets, end to end; bucket of a hash: its upper half modulo the number of buckets."""

    def __init__(self, buckets: int, parts: dict[int, bytes], crowded: np.ndarray):
        self.buckets, self.crowded = buckets, crowded
        self.size = np.zeros(buckets, np.uint64)
        self.offset = np.zeros(buckets, np.uint64)
        data, at = [], 0
        for b, bits in sorted(parts.items()):
            self.size[b], self.offset[b] = 8 * len(bits), at
            data.append(bits)
            at += 8 * len(bits)
        self.bits = np.frombuffer(b"".join(data), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        b = bucket_of(h, self.buckets)
        size, offset = self.size[b], self.offset[b]
        yes = size > 0
        safe = np.maximum(size, np.uint64(1))
        for place in _bits(h, safe):
            at = np.where(yes, offset + place, 0)
            if len(self.bits):
                yes &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return yes


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _pieces(b: pa.RecordBatch, length: int):
    """(row numbers, doc ids, places in their texts, bytes) of texts or pieces of them, about a segment together."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows, size = [], 0
    for uid, i, data in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "data"))):
        text = unpack(data) if data is not None else b""
        for at in range(0, max(len(text) - length + 1, 1), SEGMENT):
            rows.append((uid, LAST_ID if i is None else i, at, text[at : at + SEGMENT + length - 1]))
            size += len(rows[-1][3])
            if size >= SEGMENT // 2:
                yield zip(*rows)
                rows, size = [], 0
    if rows:
        yield zip(*rows)


def _span_rows(uid: np.ndarray, a: np.ndarray, z: np.ndarray, parts: int) -> list[tuple]:
    """Spans packed by the place where they meet their texts."""
    home = uid % parts
    order = np.lexsort((a, uid, home))
    cuts = np.searchsorted(home[order], np.arange(parts + 1))
    return [(SPAN, k, 0, 0, _packed(uid[o], a[o], z[o] - a[o])) for k in range(parts) if len(o := order[cuts[k] : cuts[k + 1]])]


def _spread(uid: np.ndarray, a: np.ndarray, z: np.ndarray, count: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of slices that stand `count` times in their text, `step` bytes apart: one span where they touch."""
    touch = step <= z - a
    z = np.where(touch, z + (count - 1) * step, z)
    times = np.where(touch, 1, count)
    shift = (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)) * np.repeat(step, times)
    return np.repeat(uid, times), np.repeat(a, times) + shift, np.repeat(z, times) + shift


def _runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal slices with equal keys at even distances: the first of each such run, how many they are and how far apart."""
    order = np.lexsort((start, *keys))
    if not len(order):
        return order, order, order
    o, before = order[1:], order[:-1]
    same = np.ones(len(o), bool)
    for k in keys:
        same &= k[o] == k[before]
    at = np.flatnonzero(same)
    same[at[differ(data, start[before[at]], start[o[at]], size[o[at]])]] = False
    gap = np.where(same, start[o] - start[before], 0)
    new = np.concatenate([[True], ~same])
    new[2:] |= same[1:] & same[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    step = np.zeros(len(first), np.int64)
    more = np.flatnonzero(count > 1)
    step[more] = start[order[first[more] + 1]] - start[order[first[more]]]
    return order[first], count, step


def _anchor_requests(buckets: int, length: int = LENGTH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            nonlocal held, count
            if not held:
                return
            h, low, high, n = _reduce(*(np.concatenate(x) for x in zip(*held)))
            held, count = [], 0
            b = bucket_of(h, buckets)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(buckets + 1))
            yield _batch([(0, k, 0, 0, _packed(h[o], low[o], high[o] - low[o], n[o])) for k in range(buckets) if len(o := order[cuts[k] : cuts[k + 1]])])

        for batch in batches:
            for _, ids, _, group in _pieces(batch, length):
                number, _, _, _, h = slices(list(group), length)
                doc = np.array(ids, np.int64)[number]
                # one entry for each anchor and document, with its slices
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                held.append(_reduce(h[new], doc[new], doc[new], np.diff(np.append(new, len(h)))))
                count += len(new)
                if count >= REQUESTS:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _anchor_answers(crowded_from: int):
    """For each bucket: a bit filter of the anchors that several documents have; how many slices to expect; crowded anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                h, low, more, n = _unpacked(blob, 4)
                now = (h.view(np.uint64), low, low + more, n)
                held.setdefault(k, []).append(now)
                if len(held[k]) >= 8:  # equal anchors of many batches become one entry as they come
                    held[k] = [_reduce(*(np.concatenate(x) for x in zip(*held[k])))]
        for k, parts in held.items():
            h, low, high, n = _reduce(*(np.concatenate(x) for x in zip(*parts)))
            again = low < high
            h, n = h[again], n[again]
            if not len(h):
                continue
            size = -(-16 * len(h) // 8)
            bits = np.zeros(8 * size, bool)
            for place in _bits(h, np.uint64(8 * size)):
                bits[place] = True
            yield _batch([(0, k, int(n.sum()), size, np.packbits(bits, bitorder="little").tobytes()), (1, k, 0, 0, h[n >= crowded_from].tobytes())])
        trim()

    return run


def _slice_requests(shared: Broadcast, buckets: int, parts: int, length: int = LENGTH):
    """For each suffix bucket the slices of its anchors, each distinct slice once for the smallest document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        known = shared.value
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            if not held:
                return
            *columns, data = (np.concatenate(c) for c in zip(*held))
            held, count = [], 0
            h, same, doc, uid, first, place, size, times, step = columns
            start = np.cumsum(size) - size
            order = np.lexsort((doc, same, h))
            new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(same[order]) != 0)])
            lowest = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            goes = (doc[order] > doc[lowest]) & (size[order] == size[lowest])
            at = np.flatnonzero(goes)
            goes[at[differ(data, start[lowest[at]], start[order[at]], size[order[at]])]] = False
            if goes.any():  # a smaller document of this batch has the whole slice
                o = order[goes]
                yield _batch(_span_rows(*_spread(uid[o], first[o], first[o] + size[o], times[o], step[o]), parts))
            o = order[~goes]
            bucket = ((h[o] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            o = o[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                e = o[cuts[k] : cuts[k + 1]]
                if len(e):
                    head = _packed(h[e], doc[e], uid[e], first[e], place[e], size[e], times[e], step[e])
                    text = compressor.compress(gather(data, start[e], size[e]).tobytes())
                    rows.append((SLICE, k, 0, 0, struct.pack("<q", len(head)) + head + text))
            yield _batch(rows)

        for batch in batches:
            for uids, ids, places, group in _pieces(batch, length):
                group = list(group)
                number, first, windows, place, h = slices(group, length)
                hit = known.has(h)
                number, first, windows, place, h = number[hit], first[hit], windows[hit], place[hit], h[hit]
                crowded = np.isin(h, known.crowded) if len(known.crowded) else np.zeros(len(h), bool)
                source = np.frombuffer(b"".join(group), np.uint8)
                base = np.cumsum([0, *map(len, group[:-1])])
                size = windows + length - 1
                if crowded.any():  # each window on its own, under a hash of its content
                    w = windows[crowded]
                    offset = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                    n1, f1, p1 = (np.repeat(c[crowded], w) for c in (number, first, place))
                    alone = span_hashes(source, base[n1] + f1 + offset, np.full(len(n1), length))
                    keep = ~crowded
                    number, first, place = (np.concatenate(x) for x in ((number[keep], n1), (first[keep], f1 + offset), (place[keep], p1 - offset)))
                    h, size = np.concatenate([h[keep], alone]), np.concatenate([size[keep], np.full(len(n1), length)])
                if len(h):
                    start = base[number] + first
                    same = span_hashes(source, start, size)
                    o, times, step = _runs(source, start, size, size, same, h, number)
                    n = number[o]
                    at = np.array(places, np.int64)[n] + first[o]
                    held.append((h[o], same[o], np.array(ids, np.int64)[n], np.array(uids, np.int64)[n], at, place[o], size[o], times, step, gather(source, start[o], size[o])))
                    count += len(o)
                if count >= SLICES:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _words(text: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """The bytes from each place on, `count` bytes, as big-endian 64-bit words (the last one cut)."""
    out = []
    for w in range(0, count, 8):
        value = np.zeros(len(at), np.uint64)
        for j in range(8):
            value = (value << np.uint64(8)) | (text[at + w + j].astype(np.uint64) if w + j < count else np.uint64(0))
        out.append(value)
    return out


def equal_windows(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `at` in sorted order (their numbers), and for each whether its first `length` bytes are those of the one before.

    `at` has places modulo the period at which equal strings agree. Suffixes of one residue are ordered by the bytes up to
    their next sample and the sample's rank; those of different residues can't be equal and stand by residue.
    """
    ahead = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    residue = at % PERIOD
    delta = ahead[residue]
    samples, rank_of = np.unique(at + delta, return_inverse=True)
    words = _words(text, samples, length)
    order = np.lexsort(words[::-1])
    sorted_samples = samples[order]
    # common lengths of neighbours in sample order, up to `length`
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        alive = np.ones(len(order) - 1, bool)
        for j in range(length):
            alive &= text[sorted_samples[1:] + j] == text[sorted_samples[:-1] + j]
            if not alive.any():
                break
            common[1:] += alive
    name = np.empty((max(ahead) + 1, len(order)), np.int64)
    for d in range(max(ahead) + 1):
        name[d, order] = np.cumsum(common < length - d)
    names = name[delta, rank_of.reshape(-1)]
    head = np.zeros(len(at), np.uint64)
    for j in range(max(ahead)):
        use = delta > j
        head[use] = (head[use] << np.uint64(8)) | text[at[use] + j]
    tie = names * PERIOD + residue
    order = np.lexsort((tie, head))
    same = np.concatenate([[False], (head[order][1:] == head[order][:-1]) & (tie[order][1:] == tie[order][:-1])])
    return order, same


def _sort_block(columns: list[np.ndarray], source: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (uid, from, to) that the slices of one block lose."""
    h, doc, uid, first, place, size, times, step = columns
    starts = np.cumsum(size) - size
    # equal slices are laid out and sorted once, with their smallest document
    order = np.lexsort((size, span_hashes(source, starts, size), h))
    o, before = order[1:], order[:-1]
    new = np.concatenate([[True], (h[o] != h[before]) | (size[o] != size[before])])
    at = np.flatnonzero(~new)
    new[at[differ(source, starts[order[at - 1]], starts[order[at]], size[order[at]])]] = True
    shape = np.empty(len(h), np.int64)
    shape[order] = np.cumsum(new) - 1
    one = order[new]
    low = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    # anchors at multiples of the period: a slice begins at -place modulo the period
    room = -(-(size[one] + PERIOD) // PERIOD) * PERIOD
    begin = np.cumsum(room) - room + (-place[one]) % PERIOD
    laid = np.zeros(int(room.sum()) + 2 * length + PERIOD, np.uint8)
    within = np.arange(int(size[one].sum())) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
    laid[np.repeat(begin, size[one]) + within] = gather(source, starts[one], size[one])
    windows = size[one] - length + 1
    base = np.cumsum(windows) - windows
    row = np.repeat(np.arange(len(one)), windows)
    order, tie = equal_windows(laid, begin[row] + np.arange(len(row)) - base[row], length)
    heads = np.flatnonzero(~tie)
    lowest = np.empty(len(row), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(low[row][order], heads), np.diff(np.concatenate([heads, [len(order)]])))
    # back to all slices: a window goes where its smallest document is smaller than the slice's own
    count = windows[shape]
    row = np.repeat(np.arange(len(h)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(lowest[base[shape[row]] + offset] < doc[row])
    if not len(at):
        return at, at, at
    cut = np.concatenate([[True], (np.diff(at) > 1) | (row[at][1:] != row[at][:-1])])
    a, z = at[cut], at[np.concatenate([cut[1:], [True]])]
    return _spread(uid[row[a]], first[row[a]] + offset[a], first[row[z]] + offset[z] + length, times[row[a]], step[row[a]])


def _sorted_buckets(parts: int, length: int = LENGTH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        for b in batches:
            settled = []
            for kind, k, blob in zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                if kind == SPAN:
                    settled.append((SPAN, k, 0, 0, blob))
                else:
                    held.setdefault(k, []).append(blob)
            yield _batch(settled)
        for k in sorted(held):  # one bucket at a time
            gathered = []
            for blob in held.pop(k):
                n = struct.unpack("<q", blob[:8])[0]
                gathered.append((_unpacked(blob[8 : 8 + n], 8), np.frombuffer(decompressor.decompress(blob[8 + n :]), np.uint8)))
            columns = [np.concatenate(c) for c in zip(*(p[0] for p in gathered))]
            text = np.concatenate([p[1] for p in gathered])
            gathered.clear()
            size = columns[5]
            starts = np.cumsum(size) - size
            order = np.argsort(columns[0], kind="stable")
            h = columns[0][order]
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            at = 0
            found: list = []
            while at < len(order):
                # whole anchors up to the block's size; an anchor is never split
                stop = edges[max(np.searchsorted(edges, at + BLOCK, "right") - 1, np.searchsorted(edges, at, "right"))]
                o = order[at:stop]
                found.append(_sort_block([c[o] for c in columns], gather(text, starts[o], size[o]), length))
                at = stop
            u, a, z = (np.concatenate(c) for c in zip(*found))
            yield _batch(_span_rows(u, a, z, parts))
        trim()

    return run


def cut_out(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of data without the spans; how many bytes and maximal runs went."""
    if not len(spans):
        return data, 0, 0
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    starts, ends = spans[new, 0], reach[np.concatenate([new[1:], [True]])]
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        data = [None if not t.is_valid else compress(t.as_buffer().to_pybytes()) for t in b.column("text")]
        sizes = pa.array([0 if not t.is_valid else t.as_buffer().size for t in b.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), sizes, pa.array(data, pa.binary()), b.column("extra")], ["uid", "doc_id", "size", "data", "extra"])


def _results(as_text: bool):
    """Rows in order of kind: the spans of these texts, then the texts."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if as_text else "kept"]
    kinds = [pa.int64()] * 4 + [pa.string() if as_text else pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        held: list = []
        by_uid = None

        def out(b, rows, places):
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(columns, kinds)), b.column("extra").take(pa.array(places, pa.int64()))], [*names, "extra"])

        for b in batches:
            rows: list = []
            places: list = []
            size = 0
            for i, (kind, uid, doc, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "uid", "doc_id", "data")))):
                if kind == SPAN:
                    held.append(_unpacked(data, 3))
                    continue
                if by_uid is None:
                    owner, a, n = (np.concatenate(c) for c in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
                    held.clear()
                    order = np.argsort(owner, kind="stable")
                    by_uid, spans = owner[order], np.stack([a[order], a[order] + n[order]], axis=1)
                lo, hi = np.searchsorted(by_uid, [uid, uid + 1])
                text = decompressor.decompress(data) if data is not None else b""
                kept, removed, runs = cut_out(text, spans[lo:hi])
                rows.append((doc, len(text), removed, runs, kept if not as_text else None if data is None else kept.decode("utf-8", "replace")))
                places.append(i)
                size += len(kept)
                if size > 8 << 20:
                    yield out(b, rows, places)
                    rows, places, size = [], [], 0
            yield out(b, rows, places)
        trim()

    return run


def keep(docs: DataFrame) -> DataFrame:
    """docs with the texts that are left (half a character that a cut leaves becomes U+FFFD); all rows and columns stay, null texts too.

    n_chars, where it is there, follows the text.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    left = _found(docs, [f.name for f in others], as_text=True)
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    for f in others:
        columns[f.name] = F.coalesce(F.char_length("text").cast(f.dataType), F.col("extra")[f.name]) if f.name == "n_chars" else F.col("extra")[f.name]
    return left.select(*(columns[n].alias(n) for n in docs.columns))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: one row per row of docs; `kept` holds the remaining bytes."""
    return _found(docs, [], as_text=False).drop("extra")


def _found(docs: DataFrame, others: list[str], as_text: bool) -> DataFrame:
    """One row per row of docs, with its other columns as `extra`, as they are."""
    small_batches(docs.sparkSession)
    extra = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", extra.alias("extra"))
    kind = T.StructField("extra", numbered.schema["extra"].dataType)
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    source = written(numbered.mapInArrow(_compressed, T.StructType([*long("uid", "doc_id", "size"), T.StructField("data", T.BinaryType()), kind])), "passages")
    total = source.agg(F.sum("size")).first()[0] or 0
    anchors = total // 13 + 1
    buckets, parts = max(12, -(-anchors // 500_000)), max(12, -(-total // GATHER))
    texts = source.select("uid", "doc_id", "data")
    asked = texts.mapInArrow(_anchor_requests(buckets), ROW).repartition(buckets, "bucket")
    answers = written(asked.mapInArrow(_anchor_answers(max(CROWDED, anchors // 10_000_000)), ROW), "anchor-filters")
    sizes = [(r["bucket"], r["uid"], r["doc_id"]) for r in answers.where("kind = 0").select("bucket", "uid", "doc_id").collect()]
    sort_buckets = max(12, -(-sum(n for _, n, _ in sizes) // 150_000))
    ranges, room = [[]], FILTER_BYTES
    for k, _, size in sorted(sizes):
        if room < size and ranges[-1]:
            ranges.append([])
            room = FILTER_BYTES
        ranges[-1].append(k)
        room -= size
    rows = source.select(F.lit(TEXT).alias("kind"), (F.col("uid") % parts).cast("int").alias("bucket"), "uid", "doc_id", "data", "extra")
    for part in filter(None, ranges):
        found = answers.where(F.col("bucket").isin(part)).select("kind", "bucket", "data").collect()
        known = Filter(buckets, {r["bucket"]: bytes(r["data"]) for r in found if r["kind"] == 0}, np.sort(np.frombuffer(b"".join(bytes(r["data"]) for r in found if r["kind"] == 1), np.uint64)))
        # Slices go to their bucket, and what a batch settled itself straight to the texts: one shuffle deals both.
        dealt = texts.mapInArrow(_slice_requests(docs.sparkSession.sparkContext.broadcast(known), sort_buckets, parts), ROW).repartition(sort_buckets, "kind", "bucket")
        rows = rows.unionByName(dealt.mapInArrow(_sorted_buckets(parts), ROW), allowMissingColumns=True)
    result = T.StructType([*long("doc_id", "n_bytes", "n_removed", "n_spans"), T.StructField("text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType()), kind])
    return rows.repartition(parts, "bucket").sortWithinPartitions("kind").mapInArrow(_results(as_text), result)
