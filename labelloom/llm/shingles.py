"""Hashed word shingles of normalised texts, many texts at a time in numpy.

A normalised text is lower-case words, one blank apart. A shingle is the hash of
``SIZE`` words in a row; a text with fewer words has one shingle of all its words, a
text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
#: Bytes of texts hashed at once.
BLOCK = 1 << 18

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a blob; blanks and line feeds part words."""
    x = np.frombuffer(blob, np.uint8)
    inside = (x != 32) & (x != 10)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not _POWERS or len(_POWERS[0]) < len(x):
        n = max(len(x), BLOCK + 4096)
        _POWERS[:] = [_powers(_BASE, n), _powers(_BACK, n)]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(x)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _POWERS[1][starts]
    if len(_POWERS[0]) > 16 * BLOCK:
        _POWERS.clear()  # a very long word has come by
    return mix(hashes + (ends - starts).astype(np.uint64) * _M1), starts


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of a long text, block by block."""
    out, at = [], 0
    while at < len(text):
        to = min(at + BLOCK, len(text))
        if to < len(text):
            cut = text.rfind(b" ", at, to)
            cut = text.find(b" ", to) if cut <= at else cut
            to = len(text) if cut < 0 else cut
        out.append(word_hashes(text[at:to])[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(words: np.ndarray) -> np.ndarray:
    n = len(words) - SIZE + 1
    out = words[:n].copy()
    for k in range(1, SIZE):
        out = out * _M1 + words[k : k + n]
    return mix(out)


def _whole(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a window."""
    out = words[:1].copy()
    for word in words[1:]:
        out = out * _M1 + word
    return mix(out + np.uint64(len(words)))


def groups(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, distinct shingles, their times, offsets) of runs of texts.

    Text ``first + k`` of a run has the shingles ``offsets[k]`` to ``offsets[k + 1]``, in
    ascending order.
    """
    raw = [t.encode() for t in texts]
    at = 0
    while at < len(raw):
        to, size = at + 1, len(raw[at])
        while to < len(raw) and size + len(raw[to]) < BLOCK:
            size += len(raw[to]) + 1
            to += 1
        if to - at == 1:
            words, counts = _long_words(raw[at]), None
            counts = np.array([len(words)])
        else:
            words, starts = word_hashes(b"\n".join(raw[at:to]))
            begins = np.cumsum([0, *(len(t) + 1 for t in raw[at:to])])
            counts = np.diff(np.searchsorted(starts, begins))
        yield at, *_distinct(words, counts)
        at = to


def _distinct(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= SIZE:
        within = owner[: len(words) - SIZE + 1] == owner[SIZE - 1 :]
        hashes, of = _windows(words)[within], owner[: len(words) - SIZE + 1][within]
    else:
        hashes, of = words[:0], owner[:0]
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        hashes = np.concatenate([hashes, *(_whole(words[ends[k] - counts[k] : ends[k]]) for k in short)])
        of = np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    places = np.flatnonzero(new)
    times = np.diff(np.append(places, len(hashes)))
    return hashes[places], times, np.searchsorted(of[places], np.arange(len(counts) + 1))
