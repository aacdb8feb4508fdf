"""Words of many texts at once, as codes into the list of distinct ones.

Work that depends on a word alone (its ids, its hash, its vector) is then done once per distinct
word of a block and spread over the occurrences by array indexing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of texts that are split at once; a longer text forms a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of words, with what is kept of each, that a process remembers between blocks; and the
#: longest word it remembers, for a "word" without white space may be megabytes.
MEMO_BYTES, MEMO_LONGEST, MEMO_ENTRY = 24 << 20, 64, 160


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive texts with about BLOCK_BYTES together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list]:
    """(code of each word, where each text's words begin, distinct words) of split texts."""
    offsets = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], words.dictionary.to_pylist()


class Memo:
    """f(list of words), remembered for words met again; starts anew when MEMO_BYTES are full."""

    def __init__(self, f: Callable[[list], list], known: dict | None = None):
        self.f, self.known, self.held = f, known or {}, 0
        self.fixed = dict(self.known)

    def __call__(self, words: list) -> list:
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            made = self.f([words[i] for i in new])
            for i, v in zip(new, made):
                out[i] = v
            if self.held > MEMO_BYTES:
                self.known = known = dict(self.fixed)
                self.held = 0
            for i in new:
                if len(words[i]) <= MEMO_LONGEST:
                    known[words[i]] = out[i]
                    self.held += MEMO_ENTRY + len(words[i])
        return out


def gather(parts: list[bytes], codes: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths per occurrence, all items in order) of variable-length items per distinct word."""
    pool = np.frombuffer(b"".join(parts), dtype)
    n = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
    start = np.cumsum(n) - n
    own = n[codes]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((start[codes] - (ends - own)).astype(kind), own)
    at += np.arange(total, dtype=kind)
    return own, pool[at]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets (0 where there is nothing between)."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]
