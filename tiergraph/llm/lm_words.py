"""Words, pairs of words and their hashes for language models."""

from __future__ import annotations

import numpy as np

from tiergraph.llm.shingles import U64, mix, word_hashes

#: Hashes that stand for the begin and the end of a text.
BEGIN, END = U64(0x5A17_0F3C_9E4B_21D7), U64(0xC3D2_E1F0_0FED_CBA9)
_FIRST, _SECOND, _WORD = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: Absolute discount of the pair counts.
DISCOUNT = 0.5
#: Bytes of text that are put into arrays at once.
SLICE = 1 << 20


def word_key(word: np.ndarray) -> np.ndarray:
    return mix(word * _WORD)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _FIRST + word * _SECOND)


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word before, word) of every word and of the end of every text.

    Words are runs of other than ASCII white space, A-Z lower-cased.
    """
    lowered = [(t or b"").lower() for t in texts]
    joined = np.frombuffer(b" ".join(lowered), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in lowered])
    starts, hashes = word_hashes(joined)
    ends = np.searchsorted(starts, offsets)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    last = np.cumsum(n + 1) - 1
    word = np.full(len(doc), END)
    inner = np.ones(len(doc), bool)
    inner[last] = False
    word[inner] = hashes
    before = np.concatenate([[BEGIN], word[:-1]])
    before[last - n] = BEGIN
    return doc, before, word
