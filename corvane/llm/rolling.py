"""Rabin-Karp hashes of word windows, for many texts at once."""

from __future__ import annotations

import numpy as np

from .words import LOWER

#: odd multiplier of the polynomial hash modulo 2**64, and its inverse
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: bytes hashed at once
BLOCK = 1 << 20
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have)
    return have[:n]


def word_hashes(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and each text's number of words.

    Words are runs of bytes other than space and 0x09-0x0D. A word's hash is the
    sum of (byte + 1) * BASE**i over its bytes, from running sums over the whole
    buffer, scaled back by where the word starts.
    """
    whole = b"\n".join(t or b"" for t in texts) + b"\n"
    if lower:
        whole = whole.translate(LOWER)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    out, at, a = [], [], 0
    while a < len(whole):
        b = len(whole)
        if b - a > BLOCK:
            gaps = np.flatnonzero(GAP[np.frombuffer(whole, np.uint8, BLOCK, a)])
            b = a + int(gaps[-1]) + 1 if len(gaps) else whole.index(b"\n", a + BLOCK) + 1
        x = np.frombuffer(whole, np.uint8, b - a, a)
        edge = np.diff(np.concatenate(([True], GAP[x])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            total = np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(x)))
            before = np.where(first > 0, total[first - 1], np.uint64(0))
            out.append((total[last - 1] - before) * powers(INVERSE, len(x))[first])
            at.append(first + a)
        a = b
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return mixed(np.concatenate(out)), np.diff(np.searchsorted(np.concatenate(at), ends), prepend=0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the polynomial's low bits over the word (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place; len(h) - width + 1 values.

    Windows of a power of two double: the hash of 2m words is that of the first
    m times BASE**m plus that of the next m.
    """
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, have, power, length = None, 0, h, 1
    while True:
        if width & length:
            # put this power's window in front of what is there
            if out is None:
                out, have = power, length
            else:
                scale = np.uint64(pow(BASE, have, 1 << 64))
                n = len(h) - (have + length) + 1
                out, have = power[:n] * scale + out[length : length + n], have + length
        if have == width:
            return mixed(out[: len(h) - width + 1])
        scale = np.uint64(pow(BASE, length, 1 << 64))
        power = power[: len(power) - length] * scale + power[length:]
        length *= 2


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    length = 1
    while length * 2 <= width:
        values = np.minimum(values[: len(values) - length], values[length:])
        length *= 2
    rest = width - length
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
