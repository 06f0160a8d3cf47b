"""Hashes of words between white space, A-Z in lower case."""

from __future__ import annotations

import numpy as np

from .pfp import Rolling

#: Bytes of text that are hashed at once: numpy needs some fifty times as much.
CHUNK = 1 << 20

#: Byte for byte: A-Z in lower case, white space as spaces.
NORMAL = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and each text's number of words."""
    found, counts, part, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size > CHUNK or k == len(texts) - 1:
            data = np.frombuffer(b" ".join(part).translate(NORMAL) + b" ", np.uint8)
            space = data == 32
            start = np.flatnonzero(~space & np.append(True, space[:-1]))
            end = np.flatnonzero(space & np.append(False, ~space[:-1]))
            found.append(Rolling(data).of(start, end))
            bound = np.searchsorted(start, np.cumsum([len(x) + 1 for x in part]))
            counts.append(np.diff(bound, prepend=0))
            part, size = [], 0
    return np.concatenate(found), np.concatenate(counts)
