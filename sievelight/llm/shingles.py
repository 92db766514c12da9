"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sievelight.llm import bytesops

WIDTH = 5
_MIX = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(WIDTH)], np.uint64)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of width words,
    A-Z in lower case; of all its words as one if it has fewer; none if it has none."""
    data, offsets = bytesops.utf8(column)
    for lo, hi in bytesops.chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = bytesops.LOWER[data[offsets[lo] : offsets[hi]]]
        start, end, first = bytesops.words(body, own, bytesops.IS_SPACE)
        w = bytesops.word_hashes(body, start, end)
        rolled = np.zeros(max(0, len(w) - width + 1), np.uint64)
        for k in range(width):
            rolled += w[k : k + len(rolled)] * _MIX[k]
        rolled = bytesops.mix64(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                few = (w[a:b] * _MIX[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield bytesops.mix64(np.array([few]))
            else:
                yield np.zeros(0, np.uint64)
