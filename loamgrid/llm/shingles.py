"""Word and shingle hashes of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in windows of about so many bytes, cut at white space.
WINDOW = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        out = np.full(max(n, WINDOW * 2), base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; its multipliers are fixed values of a public hash function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of data, UTF-8 bytes as uint8."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        while end < len(data) and not _SPACE[data[end - 1]]:  # on to the end of a word
            nxt = np.flatnonzero(_SPACE[data[end : end + WINDOW]])
            end = end + int(nxt[0]) + 1 if len(nxt) else min(len(data), end + WINDOW)
        part = data[at:end]
        gap = np.concatenate([[True], _SPACE[part], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        a, b = edge[0::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _power(_STEP, len(part), "up"))])
        hashes.append(mixed((sums[b] - sums[a]) * _power(_BACK, len(part) + 1, "down")[a] + (b - a).astype(np.uint64)))
        starts.append(a + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of size words; of the whole run where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out + words[i : len(words) - n + 1 + i]) * np.uint64(0xD6E8FEB86659FD93 + 2 * n) + np.uint64(i)
    return np.unique(mixed(out))


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; texts in groups of about WINDOW bytes are hashed together."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string()) if texts.nbytes < 2**31 else texts
    wide = pa.types.is_large_string(texts.type)
    _, offs, buf = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + WINDOW, side="right")) - 1)
        to = min(to, len(texts))
        # A space between texts keeps words of neighbours apart.
        joined = np.concatenate([x for i in range(at, to) for x in (data[offs[i] : offs[i + 1]] if valid[i] else data[:0], np.array([0x20], np.uint8))])
        ends = np.cumsum([(int(offs[i + 1] - offs[i]) if valid[i] else 0) + 1 for i in range(at, to)])
        hashes, starts = word_hashes(joined)
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        for i in range(to - at):
            yield shingle_hashes(hashes[cuts[i] : cuts[i + 1]], size)
        at = to
