"""Word and shingle hashing over whole Arrow columns with numpy.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered.
Texts are worked through in blocks of about ``BLOCK`` bytes, so memory does not
depend on the batch; one text is never split.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters, digits and every byte of other characters make words here.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOW = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOW[65:91] = _LOW[97:123]
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.cumprod(np.full(4096, _P, np.uint64))
_MUL = np.cumprod(np.full(8, np.uint64(0xD6E8FEB86659FD93), np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, size: int = BLOCK):
    """Yield ``(first, bytes, offsets)`` for consecutive rows of a string column
    (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_hashes(buf: np.ndarray, offs: np.ndarray, seps: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block, and the first word of each row
    (one more entry closes the last row).  ``seps`` marks the bytes between
    words."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    sep = seps[buf]
    start = ~sep
    start[1:] &= sep[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    start[heads] = ~sep[heads]
    ws = np.flatnonzero(start)
    if not len(ws):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    first = np.searchsorted(ws, offs)
    pos = np.arange(len(buf), dtype=np.int32)
    pos[ws[0] :] -= np.repeat(ws, np.diff(np.append(ws, len(buf)))).astype(np.int32)
    long = pos >= len(_POW)
    power = _POW[np.minimum(pos, len(_POW) - 1)]
    if long.any():
        power[long] = mix(pos[long].astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(_LOW[buf] * power * ~sep, ws)), first


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word of a block, and the byte after its last one."""
    sep = np.append(_SEP[buf], True)
    word = ~sep
    start, stop = word.copy(), word.copy()
    start[1:] &= sep[:-1]
    stop[:-1] &= sep[1:]
    inner = offs[1:-1]
    start[inner] = word[inner]
    inner = inner[inner > 0] - 1
    stop[inner] = word[inner]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


class Rolling:
    """Hashes of any run of consecutive words of a block, by prefix sums of
    ``word * mult**index`` that are shifted back to index 0."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, words: np.ndarray, mult: int):
        n = len(words) + 1
        self.sums = np.append(np.uint64(0), np.cumsum(words * self._power(mult, n)[: n - 1], dtype=np.uint64))
        self.back = self._power(pow(mult, -1, 1 << 64), n)

    @classmethod
    def _power(cls, mult: int, n: int) -> np.ndarray:
        have = cls._powers.get(mult)
        if have is None or len(have) < n:
            if n > 1 << 22:  # one very long text: not kept
                cls._powers.pop(mult, None)
                return np.cumprod(np.append(np.uint64(1), np.full(n - 1, mult, np.uint64)))
            have = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 18) - 1, mult, np.uint64)))
            cls._powers[mult] = have
        return have[:n]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words ``start`` to ``stop`` (exclusive)."""
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield ``(row, sorted distinct shingle hashes)`` for every row.

    With fewer than ``width`` words the whole sequence is one shingle; without
    words the set is empty.
    """
    for base, buf, offs in blocks(column):
        words, first = word_hashes(buf, offs)
        if len(words) >= width:
            grams = words[: len(words) - width + 1] * _MUL[0]
            for k in range(1, width):
                grams = grams + words[k : len(words) - width + 1 + k] * _MUL[k]
            grams = mix(grams)
        else:
            grams = words[:0]
        for i in range(len(offs) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                s = np.sort(grams[a : b - width + 1])
                yield base + i, s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                whole = (words[a:b] * _MUL[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield base + i, mix(np.array([whole], np.uint64))
            else:
                yield base + i, words[:0]
