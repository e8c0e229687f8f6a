"""numpy kernels over the UTF-8 bytes of one text: words, span hashes, shingle sets, MinHash."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Masks of the first 0 to 8 bytes, and the longest span that is hashed in steps of eight.
_HEAD, LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64), 512


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of the `width` bytes from each position on."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[: len(sums) - width]) * down[: len(sums) - width])


def byte_array(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else text or b"", dtype=np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    edge = np.diff(np.concatenate(([False], ~SPACE[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash for each span of bytes: eight bytes after the other are mixed in, so no family of texts collides by construction.

    Spans of up to 8 bytes and equal size never collide; of longer than LONG bytes a cryptographic digest is taken. Hashes of different seeds are independent.
    """
    size = ends - starts
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix((out[live] ^ (eights[at] & _HEAD[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """One hash for each word of the text, A-Z lower-cased."""
    data = LOWER[byte_array(text)]
    return span_hashes(data, *word_bounds(data))


def word_list(text: str | bytes | None) -> list[bytes]:
    """The words themselves, A-Z lower-cased."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(LOWER.tobytes()).split()


def exact_shingles(text: str | bytes | None, n: int = 5) -> set[tuple[bytes, ...]]:
    """shingle_set() as tuples of words."""
    words = word_list(text)
    return set(zip(*(words[i:] for i in range(min(n, len(words)))), strict=False)) if words else set()


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; empty if there are fewer."""
    if len(words) < n:
        return words[:0]
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total = mix(total + np.uint64(j + 1)) + words[j : len(words) - n + 1 + j]
    return mix(total + np.uint64(n))


def shingle_set(text: str | bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct shingles of n words; with fewer words the whole sequence is the one shingle; without words none."""
    words = word_hashes(text)
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else words


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhash_seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(_BASE))
    return seeds[:k] | np.uint64(1), seeds[k:]


def minhash(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], block: int = 1024) -> np.ndarray:
    """The k signature coordinates of a non-empty set."""
    a, b = seeds
    best = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), block):
        values = (a[:, None] * shingles[None, i : i + block] + b[:, None]) >> np.uint64(32)
        np.minimum(best, values.min(axis=1), out=best)
    return best.astype(np.uint32)
