"""A cuckoo filter over digests whose buckets point to stored entries."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Digest to value, for digests of 16 or more uniform bytes.

    A digest has a tag of 16 bits and two buckets of ``SLOTS`` slots, the second found from the
    first and the tag alone, so that a tag can move without its digest.  A slot holds the tag and
    the number of a stored entry; a tag that matches is a hit only if the stored digest is equal.
    An insertion that moves ``KICKS`` tags without finding room doubles the buckets and places all
    stored digests anew, so no digest is ever refused.  Deletion frees the slot and the entry.
    """

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def __len__(self) -> int:
        return len(self.digests) - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        if buckets & self.mask:
            raise ValueError("the number of buckets is a power of two")
        self.tags = array("H", bytes(2 * SLOTS * buckets))  # 0: an empty slot
        self.entries = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & self.mask)

    def _slot(self, digest: bytes) -> int:
        tag, *both = self._places(digest)
        for bucket in both:
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.tags[slot] == tag and self.digests[self.entries[slot]] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """Number of the entry of a live digest, or -1."""
        slot = self._slot(digest)
        return -1 if slot < 0 else self.entries[slot]

    def insert(self, digest: bytes, value) -> int:
        """Store a digest that is not live; the number of its entry."""
        if self.free:
            entry = self.free.pop()
            self.digests[entry], self.values[entry] = digest, value
        else:
            entry = len(self.digests)
            self.digests.append(digest)
            self.values.append(value)
        if not self._place(digest, entry):
            self._resize()
        return entry

    def delete(self, digest: bytes):
        """Forget a live digest and return its value; None if there is no such digest."""
        slot = self._slot(digest)
        if slot < 0:
            return None
        entry = self.entries[slot]
        self.tags[slot] = 0
        value, self.digests[entry], self.values[entry] = self.values[entry], None, None
        self.free.append(entry)
        return value

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((d, v) for d, v in zip(self.digests, self.values) if d is not None)

    def _place(self, digest: bytes, entry: int) -> bool:
        tag, bucket, other = self._places(digest)
        for b in (bucket, other):
            for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.entries[slot] = tag, entry
                    return True
        for kick in range(KICKS):
            slot = SLOTS * other + (entry + kick) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            entry, self.entries[slot] = self.entries[slot], entry
            other = self._other(other, tag)
            for slot in range(SLOTS * other, SLOTS * other + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.entries[slot] = tag, entry
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets or more, filled from the stored digests."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(d, i) for i, d in enumerate(self.digests) if d is not None):
                return
