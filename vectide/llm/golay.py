"""The binary Golay code of length 23, and fuzzy keys of 64-bit words made with it.

The code is perfect with radius 3: every 23-bit word decodes to exactly one of 4096 codewords. A 64-bit word is cut
into segments of 23, 23 and 18 bits. If two words differ in 4 bits at most, the two segments with the fewest errors
hold 2 errors at most between them (pigeonhole), so some word one flip or none away from both agrees with each there;
indexing each word under what all its one-flip neighbours decode to in each pair of segments loses no such pair.
"""

from __future__ import annotations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # shift and bits
PAIRS = ((0, 1), (0, 2), (1, 2))


def _remainders() -> np.ndarray:
    """Of i * x^11 by the generator, for each 12-bit i."""
    out = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _patterns(remainders: np.ndarray) -> np.ndarray:
    """The error pattern of at most three bits for each syndrome."""
    one = 1 << np.arange(23)
    two = np.unique((one[:, None] | one[None, :]).ravel())
    words = np.unique(np.concatenate([[0], (two[:, None] | one[None, :]).ravel()]))
    out = np.full(2048, -1, dtype=np.int64)
    out[remainders[words >> 11] ^ (words & 2047)] = words
    assert (out >= 0).all() and len(words) == 2048
    return out


class Golay:
    def __init__(self):
        rem = _remainders()
        err = _patterns(rem)
        words = np.arange(1 << 23, dtype=np.int32)
        self.index = ((words ^ err[rem[words >> 11] ^ (words & 2047)]) >> 11).astype(np.int16)

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index (the twelve leading bits) of the codeword nearest to each 23-bit word."""
        return self.index[words].astype(np.int64)

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys: all fuzzy keys of each unsigned 64-bit value, without repeats."""
        parts = [(values >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
        at = [self.decode(p) for p in parts]
        near = [self.decode(p[:, None] ^ (1 << np.arange(n))) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
        rows, keys = [], []
        for k, (i, j) in enumerate(PAIRS):
            raw = np.concatenate([(at[i] << 12 | at[j])[:, None], near[i] << 12 | at[j][:, None], at[i][:, None] << 12 | near[j]], axis=1)
            raw.sort(axis=1)
            new = np.ones(raw.shape, dtype=bool)
            new[:, 1:] = raw[:, 1:] != raw[:, :-1]
            r, c = np.nonzero(new)
            rows.append(r)
            keys.append(raw[r, c] | k << 24)
        return np.concatenate(rows), np.concatenate(keys)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]
