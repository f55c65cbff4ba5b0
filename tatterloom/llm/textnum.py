"""Vectorised tokenising and hashing of many texts at once, on byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_128_digest

#: The six ASCII white-space bytes: space and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_SEEDS = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_CHAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd, so a step is a bijection of its block
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a block's first bytes
LONG = 64
STEP = 1 << 18  # powers are added in such steps


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that sums of products spread over all bits."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = -(-n // STEP) * STEP
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


WORDS = Powers(0xBF58476D1CE4E5B9), Powers(0x94D049BB133111EB)


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: byte places in one buffer, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        gap = SPACES[self.buffer]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1)
        #: text i has words first[i] to first[i + 1]
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)])

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the two families are independent.

        Words of up to LONG bytes are chained eight bytes at a time through mix(), all words at once; longer ones
        take a half of XXH3-128 each.
        """
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * _CHAIN[family] + _SEEDS[family])
        padded = np.concatenate([self.buffer, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.buffer) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
        long = size > LONG
        some = np.flatnonzero(~long)
        for k in range(0, LONG, 8):
            some = some[size[some] > k]
            if not len(some):
                break
            block = eight[self.starts[some] + k] & _LOW[np.minimum(size[some] - k, 8)]
            out[some] = mix((out[some] ^ block) * _CHAIN[family] + _SEEDS[1 - family])
        for k in np.flatnonzero(long).tolist():
            both = xxh3_128_digest(self.buffer[self.starts[k] : self.ends[k]].tobytes())
            out[k] = int.from_bytes(both[8 * family : 8 * family + 8], "big")
        return out


def gram_sums(words: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which grams() hashes any run of words."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * WORDS[family].get(len(words) + 1)[0][: len(words)], out=sums[1:])
    return sums


def grams(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word sequence starts[i] to ends[i]."""
    return mix((sums[ends] - sums[starts]) * WORDS[family].get(len(sums))[1][starts])
