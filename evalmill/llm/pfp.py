"""Corpus order by prefix-free parsing, in numpy.

Triggers, places where a rolling hash of TRIGGER bytes has its low bits zero, cut each text into phrases that
overlap by the trigger. No phrase suffix longer than the trigger is a proper prefix of another, so two text
suffixes compare first by their phrase suffix, then by the rest of the parse: the suffix array of the
dictionary and that of the parse, both by prefix doubling, together order all suffixes of the corpus. Repeated
text costs one dictionary entry.
"""

from __future__ import annotations

import numpy as np

TRIGGER, MODULUS = 8, 16

_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_FACTOR, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers


class Rolling:
    """Hashes of any substrings of one array of bytes, equal for equal substrings."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of one size."""
        d = self.sums[size:] - self.sums[:-size]
        return mixed(d * self.inverse[: len(d)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _FACTOR)


def ranks(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes, by prefix doubling to at least depth symbols; a suffix stops at ends[i], and equal suffixes get equal ranks.

    Symbols are positive; ends[i] is the end of the string that position i is in.
    """
    bits = int(symbols.max(initial=1)).bit_length()
    place, step, packed = np.arange(len(symbols), dtype=np.int32), max(1, 62 // bits), symbols.astype(np.int64)
    for k in range(1, step):  # so many symbols fit one integer
        after = place + k
        packed = packed << bits | np.where(after < ends, symbols[np.minimum(after, len(symbols) - 1)], 0)
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int32) + 1
    del packed
    while step < depth:
        after = place + step
        second = np.where(after < ends, rank[np.minimum(after, len(rank) - 1)], 0)
        key = rank.astype(np.int64) * (len(rank) + 1) + second
        new = np.unique(key, return_inverse=True)[1].astype(np.int32) + 1
        same = new.max(initial=0) == rank.max(initial=0)
        rank, step = new, step * 2
        if same:
            break
    return rank


def corpus_order(texts: list[bytes], starts: list[int] | None = None, depth: int = 1 << 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of text suffixes: places in the joined texts, sorted; the joined texts; the end of each text.

    starts: from each text only its first so many places. Suffixes that are equal to depth bytes may stand in any order.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if not len(data):
        return empty, data, ends
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # the parse: a phrase from each cut to the end of the trigger at the next cut, or to the end of its text
    trigger = np.zeros(len(data), bool)
    if len(data) > TRIGGER:
        trigger[: len(data) - TRIGGER + 1] = Rolling(data).all(TRIGGER) % np.uint64(MODULUS) == 0
    trigger &= np.arange(len(data)) + TRIGGER <= ends[of]
    first = np.zeros(len(data), bool)
    first[(ends - sizes)[sizes > 0]] = True
    cut = np.flatnonzero(trigger | first)
    owner = of[cut]
    last = np.append(owner[1:] != owner[:-1], True)
    stop = np.where(last, ends[owner], np.append(cut[1:], 0) + TRIGGER)
    # a text's last phrase may end like another phrase that goes on; its own end sorts first, as suffixes stop there
    hashes = Rolling(data).of(cut, stop) ^ last.astype(np.uint64)
    _, where, phrase = np.unique(hashes, return_index=True, return_inverse=True)
    d_size = (stop - cut)[where] + last[where]  # one symbol more for the end of a text
    d_end = np.cumsum(d_size)
    d_start = d_end - d_size
    entry = np.repeat(np.arange(len(where), dtype=np.int32), d_size)
    inside = (np.arange(d_end[-1]) - d_start[entry]).astype(np.int32)
    source = (cut[where][entry] + inside).astype(np.int32)
    ended = last[where][entry] & (inside == d_size[entry] - 1)
    symbols = np.where(ended, 1, data[np.minimum(source, len(data) - 1)].astype(np.int16) + 2).astype(np.int16)
    d_rank = ranks(symbols, d_end[entry], min(depth, int(d_size.max())))
    del entry, inside, source, ended, symbols
    # the parse's suffixes
    bound = np.flatnonzero(last) + 1
    p_end = np.repeat(bound, np.diff(np.concatenate(([0], bound))))
    p_rank = ranks(np.unique(d_rank[d_start], return_inverse=True)[1][phrase] + 1, p_end, min(depth, len(cut)))
    follow = np.where(last, 0, np.append(p_rank[1:], 0))
    # each place belongs to the phrase whose cut is the last at or before it
    place = np.arange(len(data)) if starts is None else np.concatenate([empty, *(np.arange(e - s, e - s + min(n, s)) for e, s, n in zip(ends, sizes, starts))])
    at = np.searchsorted(cut, place, "right") - 1
    key = d_rank[d_start[phrase[at]] + place - cut[at]].astype(np.int64) * (int(follow.max()) + 1) + follow[at]
    return place[np.argsort(key)], data, ends


def repeated(texts: list[bytes], starts: list[int], size: int) -> np.ndarray:
    """For the first starts[i] places of each text, all joined: does the same string of so many bytes start at another of these places?"""
    order, data, _ = corpus_order(texts, starts, size)
    found = np.zeros(len(data), bool)
    window = np.arange(size)
    for k in range(0, len(order) - 1, 1 << 15):
        part = order[k : k + (1 << 15) + 1]
        same = np.zeros(len(part) - 1, bool)
        near = np.flatnonzero(data[part[:-1] + size - 1] == data[part[1:] + size - 1])  # most neighbours differ there
        near = near[data[part[near] + size // 2] == data[part[near + 1] + size // 2]]
        for j in range(0, len(near), 1 << 14):
            n = near[j : j + (1 << 14)]
            same[n] = (data[part[n][:, None] + window] == data[part[n + 1][:, None] + window]).all(1)
        found[part[:-1][same]] = True
        found[part[1:][same]] = True
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    return np.concatenate([np.empty(0, bool), *(found[f : f + n] for f, n in zip(first, starts))])
