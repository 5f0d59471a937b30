"""Cuckoo filters in numpy: sets of 64-bit hashes, nearly exact, from which members can be taken out again."""

from __future__ import annotations

import numpy as np

from .windows import mix

U = np.uint64
#: Fingerprints in a bucket, and moves after which a filter counts as full.
SLOTS, MOVES = 4, 200


class Cuckoo:
    """16-bit fingerprints in `buckets` (a power of two) buckets of four; a hash may stand in either of two.

    Never says no to a member: a member's fingerprint stays in one of its two buckets until
    it is taken out. Says yes to about one stranger in 8,000. Filled slots come first in a
    bucket; 0 is an empty one.
    """

    def __init__(self, buckets: int, data: bytes | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(buckets, SLOTS).copy()
        self.mask = U(buckets - 1)
        self._random = np.random.default_rng(buckets)

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint that stands in the first, and the other way round."""
        return bucket ^ (mix(print_.astype(U) * U(0x9E3779B97F4A7C15)) & self.mask)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = mix(h.astype(U))
        print_ = ((x >> U(48)) % U(65535) + U(1)).astype(np.uint16)
        a = x & self.mask
        return print_, a.astype(np.int64), self._other(a, print_).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(h)
        return ((self.slots[a] == print_[:, None]) | (self.slots[b] == print_[:, None])).any(axis=1)

    def add(self, h: np.ndarray) -> np.ndarray:
        """Adds distinct hashes; tells which found a place."""
        print_, a, b = self.places(h)
        left = np.arange(len(h))
        for spot in (a, b):
            left = left[~self._put(spot[left], print_[left])]
        done = np.ones(len(h), bool)
        for n, i in enumerate(left):
            if not self._push(int(a[i]), print_[i]):
                done[left[n:]] = False  # full: the rest goes elsewhere
                break
        return done

    def _put(self, spot: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of its bucket, all at once."""
        order = np.argsort(spot, kind="stable")
        s = spot[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        rank = np.arange(len(s)) - np.repeat(first, np.diff(first, append=len(s)))
        slot = np.count_nonzero(self.slots[s], axis=1) + rank
        fits = slot < SLOTS
        self.slots[s[fits], slot[fits]] = print_[order[fits]]
        done = np.zeros(len(spot), bool)
        done[order[fits]] = True
        return done

    def _push(self, bucket: int, print_: np.uint16) -> bool:
        """Puts one in the place of another, that one in its other bucket, and so on; a chain that does not end is undone."""
        moved = []
        for _ in range(MOVES):
            used = int(np.count_nonzero(self.slots[bucket]))
            if used < SLOTS:
                self.slots[bucket, used] = print_
                return True
            k = int(self._random.integers(SLOTS))
            moved.append((bucket, k, print_))
            print_, self.slots[bucket, k] = self.slots[bucket, k], print_
            bucket = int(self._other(np.array([bucket], U), np.array([print_]))[0])
        for bucket, k, own in reversed(moved):
            print_, self.slots[bucket, k] = self.slots[bucket, k], print_
            assert print_ == own
        return False

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Takes one fingerprint out for each hash; tells which were there."""
        print_, a, b = self.places(h)
        done = np.zeros(len(h), bool)
        for i in range(len(h)):
            for bucket in (a[i], b[i]):
                at = np.flatnonzero(self.slots[bucket] == print_[i])
                if len(at):
                    last = np.count_nonzero(self.slots[bucket]) - 1
                    self.slots[bucket, at[0]], self.slots[bucket, last] = self.slots[bucket, last], 0
                    done[i] = True
                    break
        return done


class Chain:
    """As many filters of one size as the members need. Their size is the same, so two hashes that one of them cannot tell apart, none can: either's fingerprint may be taken out for either."""

    def __init__(self, buckets: int, data: list[bytes] | None = None):
        self.buckets, self.filters = buckets, [Cuckoo(buckets, x) for x in data or []]

    def tolist(self) -> list[bytes]:
        return [f.tobytes() for f in self.filters]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for f in self.filters:
            out |= f.has(h)
        return out

    def add(self, h: np.ndarray) -> None:
        for f in self.filters:
            h = h[~f.add(h)]
        while len(h):
            self.filters.append(Cuckoo(self.buckets))
            h = h[~self.filters[-1].add(h)]

    def remove(self, h: np.ndarray) -> None:
        for f in self.filters:
            h = h[~f.remove(h)]
