"""Vectorised words of whole texts: spans and 64-bit hashes of the runs of bytes between white space.

A word is ``[^\\x20\\x09-\\x0D]+``.  Its hash is a polynomial over its bytes modulo 2**64, taken from prefix sums of the
whole buffer, then mixed.  Buffers are cut at document ends, and inside long documents at white space, so that memory
is bounded by BLOCK bytes and the longest word, not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, BLOCK + 4096)
        base = BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b & ((1 << 64) - 1), U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        held = (out[0], out[1])
        if n <= BLOCK + 4096:
            _powers[which] = held
    return held


def spans(buf: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap``."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[buf]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def prefix_sums(buf: np.ndarray, fold: np.ndarray, which: int) -> np.ndarray:
    up, _ = powers(len(buf) + 1, which)
    h = np.empty(len(buf) + 1, U)
    h[0] = 0
    np.cumsum((fold[buf].astype(U) + U(1)) * up[: len(buf)], out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    _, down = powers(len(h), which)
    return mix((h[ends] - h[starts]) * down[starts])


def _cuts(text: bytes, gap: np.ndarray) -> Iterator[bytes]:
    """Pieces of a long text, cut at gaps."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text):
            step = np.frombuffer(text, np.uint8, min(4096, len(text) - end), end)
            g = np.flatnonzero(gap[step])
            if len(g):
                end += int(g[0])
                break
            end += len(step)
        yield text[at:end]
        at = end


def hashed(texts: list[bytes | None], fold: np.ndarray = PLAIN, gap: np.ndarray = SPACE, bases: tuple[int, ...] = (0,)) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """(first document, hashes of its and the following documents' words by base, offsets of their first words)."""
    i = 0
    while i < len(texts):
        if len(texts[i] or b"") > BLOCK:
            parts = [_hash_one(p, fold, gap, bases) for p in _cuts(texts[i], gap)]
            words = tuple(np.concatenate(x) for x in zip(*parts))
            yield i, words, np.array([0, len(words[0])])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j] or b"") <= BLOCK and (j == i or size + len(texts[j] or b"") <= BLOCK):
            size += len(texts[j] or b"") + 1
            j += 1
        some = [t or b"" for t in texts[i:j]]
        buf = np.frombuffer(b"\n".join(some), np.uint8)
        s, e = spans(buf, gap)
        begins = np.cumsum([0] + [len(t) + 1 for t in some])
        offsets = np.searchsorted(s, begins)
        yield i, tuple(span_hashes(prefix_sums(buf, fold, b), s, e, b) for b in bases), offsets
        i = j


def _hash_one(text: bytes, fold: np.ndarray, gap: np.ndarray, bases: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(text, np.uint8)
    s, e = spans(buf, gap)
    return tuple(span_hashes(prefix_sums(buf, fold, b), s, e, b) for b in bases)


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive word hashes (one for each start that has k words)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U)
    h = w[:n].copy()
    for i in range(1, k):
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h += w[i : i + n]
    return mix(h)


def window_sums(w: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hashes of the runs of k word hashes by prefix sums, whatever k costs."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(len(w) + 1, which)
    h = np.empty(len(w) + 1, U)
    h[0] = 0
    np.cumsum(w * up[: len(w)], out=h[1:])
    return mix((h[k:] - h[:-k]) * down[:n])


def texts_of(column) -> list[bytes | None]:
    """An Arrow string column as bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
