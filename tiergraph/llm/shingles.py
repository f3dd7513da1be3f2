"""Hashed word shingles of whole texts, computed over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: ASCII white space: the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            self.up[0] = self.down[0] = U64(1)
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


#: Bytes whose words are hashed at once; a longer text takes several steps.
SEGMENT = 4 << 20


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of a byte array.

    Wide intermediate arrays are as long as a segment or the longest word.
    """
    found, at = [], 0
    while at < len(text) or not found:
        end = at + SEGMENT
        while end < len(text) and not SPACE[text[end]]:
            ahead = np.flatnonzero(SPACE[text[end : end + 4096]])
            end += int(ahead[0]) if len(ahead) else 4096
        starts, hashes = _hash_segment(text[at:end])
        found.append((starts + at, hashes))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _hash_segment(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~SPACE[text]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(text) + 1)
    sums = np.zeros(len(text) + 1, U64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, A-Z lower-cased.

    Fewer words than ``size`` make one shingle; no words make none.
    """
    lowered = [(t or b"").lower() for t in texts]
    joined = np.frombuffer(b" ".join(lowered), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in lowered])
    starts, hashes = word_hashes(joined)
    bounds = np.searchsorted(starts, offsets)
    whole = np.zeros(max(0, len(hashes) - size + 1), U64)
    for k in range(size):
        whole += hashes[k : k + len(whole)] * _PLACE[k]
    whole = mix(whole)
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= size:
            yield np.unique(whole[a : b - size + 1])
        elif n:
            yield mix((hashes[a:b] * _PLACE[:n]).sum(keepdims=True) + _PLACE[size + n])
        else:
            yield np.zeros(0, U64)
