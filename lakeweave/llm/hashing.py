"""Numpy kernels over words: where words stand, 64-bit word hashes, rolling n-gram hashes, sliding minima.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, as bytes.split() gives them.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_ROOT, _LONG = 0x9E3779B97F4A7C15, 4 << 20
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ROOT, U64), np.full(n, pow(_ROOT, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one buffer that ends with a space."""
    a = np.frombuffer(buf, np.uint8)
    space = _IS_SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(max(2 * CHUNK, 1 << (len(a) - 1).bit_length()))
    total = np.zeros(len(a) + 1, U64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


CHUNK = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes in a row, and the offsets of each text's first word (one more than texts)."""
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) < CHUNK):
            size += len(texts[to]) + 1
            to += 1
        if to == at + 1 and len(texts[at]) > _LONG:  # a very long text goes through in pieces cut at spaces
            for piece in _cut(texts[at]):
                got = _hashed(piece + b" ")[1]
                counts[at] += len(got)
                hashes.append(got)
        else:
            start, got = _hashed(b" ".join(texts[at:to]) + b" ")
            first = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
            counts[at:to] = np.diff(np.searchsorted(start, first))
            hashes.append(got)
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.concatenate(([0], np.cumsum(counts)))


def _cut(text: bytes):
    at = 0
    while at < len(text):
        to = at + _LONG
        while to < len(text) and text[to] not in SPACES:
            to += 1
        yield text[at:to]
        at = to


def grams(hashes: np.ndarray, n: int, step: int = _STEP) -> np.ndarray:
    """Rolling hash of each n consecutive values, mixed; built from powers of two, so in log n passes."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out, width, block, size, done = None, 0, hashes, 1, 0
    while True:
        if n >> done & 1:
            if out is None:
                out, width = block, size
            else:  # the block stands before what there is
                m = len(hashes) - (width + size) + 1
                out = block[:m] * U64(pow(step, width, 1 << 64)) + out[size : size + m]
                width += size
        done += 1
        if n >> done == 0:
            return mix(out[: len(hashes) - n + 1])
        block = block[:-size] * U64(pow(step, size, 1 << 64)) + block[size:]
        size *= 2


def sliding_min(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w consecutive values and its leftmost place, in log w passes."""
    if len(values) < w:
        return values[:0], np.zeros(0, np.int64)

    def least(a, b, shift, n):
        x, y = a[0][:n], b[0][shift : shift + n]
        right = y < x
        return np.where(right, y, x), np.where(right, b[1][shift : shift + n], a[1][:n])

    size, out = 1, (values, np.arange(len(values)))
    while 2 * size <= w:
        out = least(out, out, size, len(out[0]) - size)
        size *= 2
    return least(out, out, w - size, len(values) - w + 1)


def within(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of n-grams that don't cross from one text into the next, and each one's text."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][text], text
