"""Repeated fixed-length windows over token sequences, vectorised in numpy.

Every window of ``width`` tokens owns one *anchor*: the leftmost smallest hash among the
``gram``-token grams inside it (a minimizer).  The choice depends on the window's content
alone, so equal windows always own equal anchors at equal offsets, and a whole corpus of
windows is represented by about ``2 / (width - gram + 2)`` records a token:

    (h, c, place, times)   h: digest of the anchor gram; c: digest of the text that the run
                    of windows owned by this anchor covers; place: where the run starts,
                    how many windows it has, and where the anchor stands in it; times: how
                    often the same run follows upon itself, as in text that repeats a short
                    period, so that such text has few records too.

Two runs with equal (h, c), 128 independent bits, hold the same windows, all of them.  Runs
with equal h and different c can share some windows; those are compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
#: Tokens handled at once; longer documents are taken in overlapping stretches.
STRETCH = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: One odd factor pair for each independent family of digests.
_FACTORS = _seeded(8, 1) | U(1)
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def loads(data: np.ndarray) -> np.ndarray:
    """For every byte the eight bytes from there on as one number; past the end: zeros. A view of a padded copy."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


class Digests:
    """Digests of stretches of one token array, by doubling: that of twice as many tokens mixes
    those of its halves. A stretch of any length is told by the first and the last stretch of
    the largest power of two in it. Mixing is not linear, so no texts are known that collide.
    Bytes are taken eight at a time to begin with, as they are. `family` (0 to 3) picks
    independent digests."""

    def __init__(self, tokens: np.ndarray, family: int):
        self.k, self.l = _FACTORS[2 * family : 2 * family + 2]
        self.least = 8 if tokens.dtype == np.uint8 else 1
        base = loads(tokens)[: max(0, len(tokens) - 7)] if self.least == 8 else tokens
        self.base = mix(base ^ self.k)
        self.size = len(tokens)

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * self.k
        x ^= x >> U(32)
        x += b
        x *= self.l
        x ^= x >> U(29)
        return x

    def _levels(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        span, level = self.least, self.base
        while True:
            yield span, level
            if 2 * span > longest:
                return
            level = self._join(level[: max(0, len(level) - span)], level[span:])
            span *= 2

    def all(self, width: int) -> np.ndarray:
        """Of every stretch of `width` tokens."""
        *_, (span, level) = self._levels(width)
        n = max(0, self.size - width + 1)
        return mix(self._join(level[:n], level[width - span : width - span + n]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of some stretches, none shorter than eight bytes or one token."""
        size = end - start
        out = np.zeros(len(start), U)
        for span, level in self._levels(int(size.max()) if len(size) else 0):
            at = np.flatnonzero((size >= span) & (size < 2 * span))
            if len(at):
                out[at] = self._join(level[start[at]], level[end[at] - span]) + size[at].astype(U) * self.l
        return mix(out)


def leftmost_min(values: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the leftmost least of values[i:i+w], in linear time."""
    n = len(values)
    keys = (values & ~U((1 << 24) - 1)) | np.arange(n, dtype=U)
    padded = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U((1 << 24) - 1)).astype(np.int64)


def stretches(bounds: np.ndarray, width: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, one past the last, first token, one past the last) of pieces of about `size` tokens."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        if bounds[j] - bounds[i] <= 2 * size:
            yield i, j, int(bounds[i]), int(bounds[j])
        else:  # one very long document
            at, end = int(bounds[i]), int(bounds[j])
            while at + width <= end:
                yield i, j, at, min(at + size + width - 1, end)
                at += size
        i = j


def records(tokens, bounds: np.ndarray, width: int, gram: int, size: int = STRETCH):
    """Arrays (document, h, c, place, times) over all documents; tokens(a, b) gives those from a to b, bounds the documents' offsets."""
    w = width - gram + 1
    parts = []
    for i, j, a, b in stretches(bounds, width, size):
        if b - a < width:
            continue
        t = tokens(a, b)
        grams = Digests(t, 0).all(gram)
        own = leftmost_min(grams, w)
        ends = np.minimum(bounds[i + 1 : j + 1], b)
        begins = np.maximum(bounds[i:j], a)
        valid = np.zeros(len(own) + 1, np.int32)
        keep = ends - begins >= width
        np.add.at(valid, begins[keep] - a, 1)
        np.add.at(valid, ends[keep] - width + 1 - a, -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(at):
            continue
        o = own[at]
        cut = np.flatnonzero((np.diff(o) != 0) | (np.diff(at) != 1))
        first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
        lo, hi, p = at[first], at[last], o[first]
        doc = np.searchsorted(bounds, lo + a, side="right") - 1
        h, c = grams[p], Digests(t, 1).of(lo, hi + width)
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]) & (lo[1:] == hi[:-1] + 1)
        one = np.flatnonzero(np.concatenate(([True], ~same)))
        place = ((lo + a - bounds[doc]) << 16) | ((hi - lo) << 8) | (p - lo)
        parts.append((doc[one], h[one].view(np.int64), c[one].view(np.int64), place[one], np.diff(one, append=len(h))))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def unpack(place):
    """(first window's start, windows) of a place."""
    return place >> 16, ((place >> 8) & 255) + 1


def portions(batch, column: str = "text", limit: int = 2 << 20):
    """The batch in pieces of at most `limit` bytes of text, or one row."""
    sizes = np.cumsum(np.diff(utf8(batch.column(column))[1]))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its rows' offsets; null: empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_hashes(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of up to 16 bytes are two numbers and a length, which are mixed; longer ones are hashed one by one."""
    size, number = end - start, loads(d)
    low = number[start] & _FIRST[np.minimum(size, 8)]
    high = number[np.minimum(start + 8, len(d))] & _FIRST[np.clip(size - 8, 0, 8)]
    out = mix(mix(low * _FACTORS[6] + size.astype(U)) + high * _FACTORS[7])
    for i in np.flatnonzero(size > 16):
        out[i] = int.from_bytes(blake2b(d[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    return _word_hashes(data, offsets[:-1], offsets[1:])


def _between_words(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Like stretches(), but a long document is only cut before a separator."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > 2 * size:
            to = at + size
            while to < end and not _SPACE[data[to]]:
                gap = np.flatnonzero(_SPACE[data[to : min(to + size, end)]])
                to = to + int(gap[0]) if len(gap) else min(to + size, end)
            yield i, j, at, to
            at = to
        yield i, j, at, end
        i = j


def words(data: np.ndarray, offsets: np.ndarray, size: int = STRETCH):
    """Word starts and ends as byte positions, word hashes, and the documents' word offsets.

    A word is a run of bytes other than space and 0x09-0x0D within one document.
    """
    starts, ends, hashes = [], [], []
    for i, j, a, b in _between_words(data, offsets, size):
        d = data[a:b]
        solid = ~_SPACE[d]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = offsets[i + 1 : j] - a
        edges = edges[(edges > 0) & (edges < len(d))]
        first[edges] |= solid[edges]
        last[edges - 1] |= solid[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(_word_hashes(d, s, e))
        starts.append(s + a)
        ends.append(e + a)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts, ends, hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, U)
    return starts, ends, hashes, np.searchsorted(starts, offsets)
