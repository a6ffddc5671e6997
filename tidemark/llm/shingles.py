"""Word-shingle sets of whole texts, hashed in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LANES, U64, finish, slices, text_buffers, word_hashes


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its ``width``-word shingles.

    Fewer words than ``width`` (but at least one) make one shingle, the whole sequence;
    without words or text the set is empty.
    """
    raw, bounds = text_buffers(column)
    for i, j in slices(bounds):
        words, at = word_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        n = len(words)
        full = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            full += words[k : n - width + 1 + k] * LANES[k]
        full = finish(full)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(full[a : b - width + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                few = words[a:b] * LANES[: b - a]
                yield finish(few.sum(dtype=np.uint64, keepdims=True) + LANES[32 + b - a])
            else:
                yield np.zeros(0, np.uint64)


def signature(tokens: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, the same for equal sets."""
    h = finish(tokens ^ U64(0x5851F42D4C957F2D))
    return int(finish(h.sum(dtype=np.uint64, keepdims=True) + U64(len(tokens)))[0])
