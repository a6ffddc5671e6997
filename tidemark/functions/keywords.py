"""Many substrings at once: an Aho-Corasick automaton over the bytes of a column of texts.

All keywords are in one automaton, whose table of transitions is dense over the classes of
bytes that keywords hold.  Each state carries a mask of the topics whose keywords end there.
A batch of texts is one buffer, with a byte between texts that leads back to the start; it is
cut into stretches of equal width that all take a step at once.  A stretch begins as many
bytes early as the longest keyword may reach back, so that no hit is lost at a cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of a stretch, and stretches that take a step at once.
WIDTH, LANES = 512, 8192
#: No UTF-8 text holds this byte.
BETWEEN = 0xFF


class Automaton:
    """Keywords of up to 63 topics, in order of precedence."""

    def __init__(self, topics: Mapping[str, Sequence[str]]):
        if len(topics) > 63:
            raise ValueError("a mask holds 63 topics")
        self.names = list(topics)
        words = [(w.encode(), 1 << k) for k, ws in enumerate(topics.values()) for w in ws]
        self.always = sum({m for w, m in words if not w})  # an empty keyword is in every text
        words = [(w, m) for w, m in words if w]
        used = sorted({b for w, _ in words for b in w})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.longest = max((len(w) for w, _ in words), default=1)

        edges: list[dict[int, int]] = [{}]
        masks = [0]
        for word, mask in words:
            at = 0
            for b in word:
                at = edges[at].setdefault(int(self.classes[b]), len(edges))
                if at == len(edges):
                    edges.append({})
                    masks.append(0)
            masks[at] |= mask
        # Failure links, breadth first: a state goes where its longest proper suffix goes.
        wide = len(used) + 1
        table = np.zeros((len(edges), wide), np.int32)
        fail, queue = [0] * len(edges), deque(edges[0].values())
        for c, to in edges[0].items():
            table[0, c] = to
        while queue:
            at = queue.popleft()
            masks[at] |= masks[fail[at]]
            table[at] = table[fail[at]]
            for c, to in edges[at].items():
                fail[to] = int(table[fail[at], c])
                table[at, c] = to
                queue.append(to)
        # States that say something come last, so that one comparison tells them.
        order = np.argsort(np.array(masks) != 0, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.first = int(np.count_nonzero(np.array(masks) == 0)) * wide
        self.table = (rank[table[order]] * wide).ravel().astype(np.int32)
        self.wide, self.masks = wide, np.array(masks, np.int64)[order]

    def found(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mask of topics of each text ``raw[bounds[i]:bounds[i + 1]]``."""
        rows = len(bounds) - 1
        out = np.full(rows, self.always, np.int64)
        step = WIDTH * LANES
        ends = bounds[1:] + np.arange(1, rows + 1)  # behind the byte that follows each text
        spaced = np.full(len(raw) + rows, BETWEEN, np.uint8)
        keep = np.ones(len(spaced), bool)
        keep[ends - 1] = False
        spaced[keep] = raw
        early = self.longest - 1
        for lo in range(0, len(spaced), step):
            part = spaced[max(0, lo - early) : lo + step]
            lanes = -(-(min(len(spaced), lo + step) - lo) // WIDTH)
            padded = np.full(early + lanes * WIDTH, BETWEEN, np.uint8)
            at = early - (lo - max(0, lo - early))
            padded[at : at + len(part)] = part
            view = np.lib.stride_tricks.as_strided(padded, (early + WIDTH, lanes), (1, WIDTH))
            state, hits, masks = np.zeros(lanes, np.int32), [], []
            for k, column in enumerate(self.classes[view]):
                state = self.table[state + column]
                if (hit := np.flatnonzero(state >= self.first)).size:
                    hits.append(hit * WIDTH + (k + lo - early))
                    masks.append(state[hit])
            if hits:
                row = np.searchsorted(ends, np.concatenate(hits), "right")
                mask = self.masks[np.concatenate(masks) // self.wide]
                order = np.argsort(row, kind="stable")
                row, mask = row[order], mask[order]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[first]] |= np.bitwise_or.reduceat(mask, first)
        return out

    def topics(self, texts: pa.Array, other: str) -> pa.Array:
        """The first topic of each text, else ``other``; of null texts too."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        mask = self.found(raw, bounds - bounds[0])
        lowest = mask & -mask
        number = np.where(mask == 0, len(self.names), np.log2(np.maximum(lowest, 1)).astype(np.int64))
        return pa.array([*self.names, other]).take(pa.array(number))
