"""Sets of five-word shingles, as digests, for many texts at a time.

Words are hashed by one running sum over the bytes of many texts: a word's digest is the difference of the sum at its
ends, brought to the place 0. A shingle's digest is a sum of its words' digests, each times a constant of its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE = 5
CHUNK, LONG = 1 << 18, 512  # bytes at a time; longer words are hashed by themselves
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([_BASE, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BYTES[_SPACE] = 0
_GAP = re.compile(rb"[\x09-\x0d\x20]")
_POWERS = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * CHUNK, _BASE, np.uint64))))
_INVERSE = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * CHUNK, pow(_BASE, -1, 1 << 64), np.uint64))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEPS[1]
    return x ^ (x >> np.uint64(29))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digest and start of each word of at most 2 CHUNK bytes."""
    buf = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[buf], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[buf] * _POWERS[: len(buf)], dtype=np.uint64)))
    h = _mixed((total[end] - total[start]) * _INVERSE[start])
    for k in np.flatnonzero(end - start > LONG):
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return h, start


def _long_words(raw: bytes) -> np.ndarray:
    """Digests of the words of a text of any length, piece by piece."""
    out, at = [], 0
    while at < len(raw):
        stop = at + CHUNK
        if stop < len(raw):
            gap = _GAP.search(raw, stop)
            stop = gap.start() if gap else len(raw)
        piece = raw[at:stop]
        out.append(_words(piece)[0] if len(piece) <= 2 * CHUNK else np.array([_words(w)[0][0] if len(w) <= LONG else xxhash.xxh3_64_intdigest(w) for w in piece.split()], np.uint64))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _joined(h: np.ndarray) -> np.ndarray:
    n = len(h) - SHINGLE + 1
    out = h[:n] * _STEPS[0]
    for k in range(1, SHINGLE):
        out += h[k : n + k] * _STEPS[k]
    return _mixed(out)


def _set(found: np.ndarray) -> np.ndarray:
    found.sort()
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def _short(raw: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.split()))], np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted digests of its set of five-word shingles (of a shorter text, of the whole sequence); A-Z lower-cased."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        raw = b"\n".join(held)
        h, start = _words(raw)
        first = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in held]))  # number of each text's first word
        every = _joined(h) if len(h) >= SHINGLE else h[:0]
        for k, text in enumerate(held):
            a, b = int(first[k]), int(first[k + 1]) - SHINGLE + 1
            yield _set(every[a:b].copy()) if b > a else _short(text)
        held.clear()

    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) + 1 > CHUNK:
            yield from flush()
            size = 0
        if len(raw) > CHUNK:
            h = _long_words(raw)
            yield _set(_joined(h)) if len(h) >= SHINGLE else _short(raw)
        else:
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield from flush()


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))
