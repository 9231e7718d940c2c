"""Longest runs of wanted bytes in whole Arrow batches of texts, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Spans:
    """Runs in the order of the texts: first byte, length, number of the text; and their bytes, A-Z lower-cased,
    one run after the other (run ``i`` begins at ``at[i]``)."""

    start: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    data: np.ndarray
    at: np.ndarray

    def strings(self) -> pa.Array:
        """The runs as Arrow binaries."""
        ends = np.append(self.at, len(self.data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.at), [None, pa.py_buffer(ends), pa.py_buffer(self.data)])


def spans(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray) -> Spans:
    """Longest runs of bytes for which ``wanted`` (256 flags) holds; no run crosses the border of two texts.

    ``offsets`` begin at 0 and have one entry more than there are texts; empty texts have no runs.
    """
    inside = wanted[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    owner = np.searchsorted(offsets, start, side="right") - 1
    return Spans(start, length, owner, LOWER[data[inside]], np.cumsum(length) - length)
