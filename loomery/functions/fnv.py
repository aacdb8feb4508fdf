"""FNV-1a over arrays, in numpy: MinHash signatures and band keys."""

from __future__ import annotations

import numpy as np

#: The published 64-bit offset basis and prime.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
VALUES, ROWS = 128, 4
#: Elements that a signature takes in one step.
AT_ONCE = 1024


def _bytes(h: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Hashes continued by the ``n`` low bytes of each x, little end first."""
    for j in range(n):
        h = (h ^ ((x >> np.uint64(8 * j)) & np.uint64(255))) * np.uint64(PRIME)
    return h


def signature(elements: np.ndarray) -> np.ndarray:
    """VALUES minima of the hash of (element, 8 bytes; index, 4 bytes); all ones for an empty set."""
    if not len(elements):
        return np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    x = np.asarray(elements).astype(np.int64).view(np.uint64)
    h = _bytes(np.full(len(x), BASIS, np.uint64), x, 8)
    # An index has one byte that is not zero; zeros only multiply. All indexes are taken at once, some elements at a time.
    index, last = np.arange(VALUES, dtype=np.uint64)[:, None], np.uint64(pow(PRIME, 4, 1 << 64))
    least = [((h[None, at : at + AT_ONCE] ^ index) * last).min(1) for at in range(0, len(h), AT_ONCE)]
    return np.min(least, axis=0)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band of ROWS values, for each row of signatures."""
    bands = signatures.reshape(len(signatures), -1, ROWS)
    h = np.full(bands.shape[:2], BASIS, np.uint64)
    for j in range(ROWS):
        h = _bytes(h, bands[:, :, j], 8)
    return h
