"""Vectorised word and shingle hashes of batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: odd multipliers (binary digits of the golden ratio and mixing constants)
BASE = U(0x9E3779B97F4A7C15)
MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: bytes of words: digits, small letters, anything beyond ASCII
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in range(256)])
#: text bytes handled at once (a longer text is one batch by itself)
BATCH_BYTES = 1 << 20
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * MIX[0]
    x = x ^ (x >> U(33))
    x = x * MIX[1]
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BATCH_BYTES + (1 << 16))
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [
            np.cumprod(np.concatenate([np.ones(1, U), np.full(size, b, U)])) for b in (BASE, inverse)
        ]
    return _POWERS[0], _POWERS[1]


def batches_of(texts: list[str | None], limit: int = BATCH_BYTES):
    """Ranges of texts whose size is about ``limit`` bytes, with their bytes."""
    at, size, group = 0, 0, []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        group.append(raw)
        size += len(raw)
        if size >= limit:
            yield at, group
            at, size, group = k + 1, 0, []
    if group:
        yield at, group


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and per text the end of its words."""
    data = FOLD[np.frombuffer(b"\0".join([*raw, b""]), np.uint8)]
    ends = np.cumsum([len(b) + 1 for b in raw])
    inside = WORD[data]
    flips = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = flips[0::2], flips[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    words = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(U))
    return words, np.searchsorted(starts, ends)


def shingles(words: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of a text, and per text their end.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    begins = np.concatenate([[0], stops[:-1]])
    counts = stops - begins
    total = np.zeros(max(len(words) - size + 1, 0), U)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * U((2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(n)
    out = np.empty(ends[-1] if len(ends) else 0, U)
    long = counts >= size
    owner = np.repeat(np.arange(len(n)), np.where(long, n, 0))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(long, n, 0)) - np.where(long, n, 0), np.where(long, n, 0))
    out[(ends - n)[owner] + place] = mix(total[begins[owner] + place])
    for t in np.flatnonzero(~long & (counts > 0)):
        few = words[begins[t] : stops[t]]
        odd = U(3) + U(2) * np.arange(len(few), dtype=U)
        out[ends[t] - 1] = mix(np.array([(few * odd).sum(dtype=U) + U(len(few))], U))[0]
    return out, ends


def sequence_key(words: np.ndarray) -> bytes:
    """128-bit key of a word sequence."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
