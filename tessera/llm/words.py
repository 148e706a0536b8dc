"""Words of texts as 64-bit hashes, found in whole arrays of bytes at a time."""

from __future__ import annotations

import re

import numpy as np

#: Odd numbers without a pattern, to multiply hashes by.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of a text that are hashed in one go, up to the next white space.
CHUNK = 1 << 20
SPACES = b"\t\n\v\f\r "


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of tokens; a bijection, so equal values mean equal tokens."""
    h = h * ODD[k % len(ODD)] + np.uint64(k)
    h ^= h >> np.uint64(31)
    return h * ODD[(k + 1) % len(ODD)]


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> Powers:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.append(np.uint64(1), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)) for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self


class Words:
    """Hashes of texts' words, A-Z lower-cased, a chunk at a time; a worker makes one."""

    def __init__(self):
        self.space = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
        letters = np.arange(256, dtype=np.uint64)
        letters[65:91] += np.uint64(32)
        self.letter = mixed(letters + np.uint64(1), 1)
        self.powers, self.blank = Powers(int(ODD[2])), re.compile(rb"[\t-\r ]")

    def hashes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins, and its hash."""
        data, places, out, at = np.frombuffer(raw, np.uint8), [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while at < len(data):
            end = len(data)
            if at + CHUNK < end:
                gap = self.blank.search(raw, at + CHUNK)
                end = gap.start() if gap else end
            x = data[at:end]
            p = self.powers.grow(len(x) + 1)
            blank = np.ones(len(x) + 2, bool)
            blank[1:-1] = self.space[x]
            edges = np.flatnonzero(blank[1:] != blank[:-1])
            starts, ends = edges[::2], edges[1::2]
            sums, value = np.zeros(len(x) + 1, np.uint64), self.letter[x]
            value *= p.up[: len(x)]
            np.cumsum(value, out=sums[1:])
            places.append(starts + at)
            out.append(mixed((sums[ends] - sums[starts]) * p.down[starts], 0))
            at = end
        return np.concatenate(places), np.concatenate(out)
