"""Words of a run of texts as arrays: where they stand, whose they are, and a 64-bit hash of each.

Words are [^\\x20\\x09-\\x0D]+ over the UTF-8 bytes. The hash of a word is taken from prefix sums of a
polynomial in an odd 64-bit base, divided by the power at its start, and mixed; it depends on the word's
bytes only, so it is the same on every machine.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes whose words are looked for together, so that what is held a byte is held for these alone.
BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2**64; a table of a block's powers is kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK + 4096), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= BLOCK + 4096:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """texts: UTF-8. start, end: byte offsets in `buf`; doc: index of the text; hash; first: for each text
    the index of its first word, and at the end the number of words."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        starts, ends, hashes, low = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while low < len(joined):  # a block ends with white space, as the whole does
            high = _BLANK.search(joined, min(low + BLOCK, len(joined) - 1)).end()
            for held, part in zip((starts, ends, hashes), self._block(self.buf[low:high], low), strict=True):
                held.append(part)
            low = high
        self.start, self.end, self.hash = map(np.concatenate, (starts, ends, hashes))
        self.at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.at)

    @staticmethod
    def _block(buf: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of the words of a block that begins at `low`."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf]))))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf)), out=sums[1:])
        return start + low, end + low, mix((sums[end] - sums[start]) * _power(_INVERSE, len(buf))[start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + self.hash[j : n + j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(out[at])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every distinct run of k words of each text, ordered by text and hash; a text of
        fewer words, but some, has its whole sequence as one."""
        at, hashes = self.windows(k)
        doc = self.doc[at]
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = counts[short] > j
            whole[more] = whole[more] * np.uint64(_BASE) + self.hash[self.first[short[more]] + j]
        doc, hashes = np.concatenate((doc, short)), np.concatenate((hashes, mix(whole + counts[short].astype(np.uint64))))
        order = np.argsort(hashes)
        order = order[np.argsort(doc[order].astype(np.uint16 if self.n < 65536 else np.int64), kind="stable")]
        doc, hashes = doc[order], hashes[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        return doc[keep], hashes[keep]
