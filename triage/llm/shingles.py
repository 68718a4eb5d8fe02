"""Word-shingle sets of many texts at once, with NumPy over one byte buffer."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _powers(n: int, cache={}) -> np.ndarray:  # noqa: B006 one table a process
    have = cache.get("p")
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _MUL, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        cache["p"] = have
    return have


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (uint64), ascending within each text, and where each text's begin (n + 1 offsets).

    Words are runs of other bytes than white space, A-Z lower-cased. A text of
    fewer than `width` words has its whole sequence as one shingle; one of no
    words has none. Hashes are 64 bits wide and the same on every machine.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
    b = _LOWER[raw]
    gap = _BLANK[b]
    word = ~gap
    edge = np.diff(np.concatenate(([False], word)).view(np.int8))
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    stop = np.flatnonzero(edge == -1)
    # Hash of a word: sum of (byte + 1) * MUL^place, finalised together with its length.
    length = stop - start
    which = np.repeat(np.arange(len(start)), length)
    inside = np.flatnonzero(word)
    place = inside - start[which]
    terms = (b[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()) + 1)[place]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    h = mix64(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(ends, start, side="right")
    count = np.bincount(owner, minlength=n)
    # Shingles that start at each word and stay in its text.
    at = np.concatenate(([0], np.cumsum(count)))
    left = at[owner + 1] - np.arange(len(start))
    s = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = h[k:] if k else h
        s[: len(part)] = mix64(s[: len(part)] * _MUL + part)
    ok = left >= width
    short = np.flatnonzero((count > 0) & (count < width))
    for t in short:  # a few words each
        v = np.uint64(0)
        for x in h[at[t] : at[t + 1]]:
            v = mix64(np.array([v], np.uint64) * _MUL + x)[0]
        s[at[t]], ok[at[t]] = v ^ np.uint64(count[t]), True
    s, owner = s[ok], owner[ok]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[fresh], owner[fresh]
    return s, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def chunks(values, limit: int = 1 << 20):
    """Slices of a list of bytes of about `limit` bytes; a longer text is a slice of its own."""
    begin, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(v)
    if begin < len(values):
        yield begin, len(values)
