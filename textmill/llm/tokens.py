"""Vectorised words of UTF-8 text for Arrow batches: 64-bit word hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE, _SALT = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)
#: Bytes that are hashed at a time; a longer word is hashed block by block.
PIECE = 1 << 18

#: Bytes of words for shingles (ASCII letters and digits, all of any non-ASCII character), and folded to lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of words between blanks (all but space and 0x09-0x0D).
VISIBLE = np.ones(256, bool)
VISIBLE[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        up, down = np.ones(PIECE + 1, U), np.ones(PIECE + 1, U)
        up[1:], down[1:] = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        _powers.extend((np.multiply.accumulate(up), np.multiply.accumulate(down)))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the maximal runs of bytes that are `inside`, ASCII letters folded to lower case."""
    up, down = _tables()
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    starts, ends = edges[0::2], edges[1::2]
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + PIECE, "right"))
        if j == i:  # one word beyond a piece
            h = U(0)
            for at in range(int(starts[i]), int(ends[i]), PIECE):
                part = LOWER[data[at : min(at + PIECE, int(ends[i]))]].astype(U) + U(1)
                h = mix(np.array([h * U(31) + (part * up[: len(part)]).sum(dtype=U)], U))[0]
            out[i] = h ^ U(int(ends[i] - starts[i]))
            i += 1
            continue
        begin = int(starts[i])
        part = LOWER[data[begin : int(ends[j - 1])]].astype(U) + U(1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (sums[e] - sums[s]) * down[s] ^ ((e - s).astype(U) * _SALT)
        i = j
    return mix(out), starts


def slices(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, document starts) for runs of texts of about `size` bytes; None counts as empty."""
    first, parts, held = 0, [], 0
    for k, t in enumerate(texts):
        parts.append((t or "").encode("utf-8", "replace"))
        held += len(parts[-1]) + 1
        if held >= size or k + 1 == len(texts):
            at = np.zeros(len(parts), np.int64)
            np.cumsum([len(p) + 1 for p in parts[:-1]], out=at[1:])
            yield first, k + 1, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), at
            first, parts, held = k + 1, [], 0


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words in order; fewer words are one shingle, no words none."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(np.array([sum(int(w) * (2 * k + 3) for k, w in enumerate(words)) + len(words) & (1 << 64) - 1], U))
    h = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        h = h * U(0xC2B2AE3D27D4EB4F) + words[k : len(words) - n + 1 + k]
    return mix(h)
