"""Words of texts, found in whole byte arrays at once.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. In UTF-8
all bytes of a character beyond ASCII lie above 0x7F, so the rule holds byte by byte. Operators that part
texts at blanks alone pass ``NOT_BLANK`` and ``LOWER`` instead.
"""

from __future__ import annotations

import numpy as np

_codes = np.arange(256)
IS_WORD = (
    ((_codes >= 0x30) & (_codes <= 0x39))
    | ((_codes >= 0x41) & (_codes <= 0x5A))
    | ((_codes >= 0x61) & (_codes <= 0x7A))
    | (_codes >= 0x80)
)
_lower = _codes + 32 * ((_codes >= 0x41) & (_codes <= 0x5A))
#: Lower-cased byte of a word, a blank for all others.
NORMAL = np.where(IS_WORD, _lower, 0x20).astype(np.uint8)

NOT_BLANK = (_codes != 0x20) & ((_codes < 0x09) | (_codes > 0x0D))
LOWER = _lower.astype(np.uint8)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_bounds(data: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word. Texts must be parted by a byte outside words."""
    inside = is_word[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edges[::2], edges[1::2]


def words_before(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each position, how many words start before it."""
    return np.searchsorted(starts, positions, side="left")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, normal_bytes: np.ndarray = NORMAL) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: its bytes, eight at a time, folded in order."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _MIX + np.uint64(1))
    if not len(starts):
        return out
    normal = np.r_[normal_bytes[data], np.zeros(8, np.uint8)]
    eights = np.lib.stride_tricks.sliding_window_view(normal, 8)
    masks = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
    at, live = starts.copy(), np.arange(len(starts))
    while len(live):
        left = ends[live] - at
        part = np.ascontiguousarray(eights[at]).view(np.uint64).ravel() & masks[np.minimum(left, 8)]
        out[live] = mix(out[live] * _MIX + part)
        on = left > 8
        live, at = live[on], at[on] + 8
    return out
