"""MD5 of many short texts at once, by whole arrays: the draws of resamples and replications, of which every row has hundreds.

A text is a prefix, the same for all, and a part of its own. What doesn't depend on the prefix is laid out once, so that another prefix costs the rounds only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [g for r in ((1, 0), (5, 1), (3, 5), (7, 0)) for g in ((r[0] * i + r[1]) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
_ADDED, _LEFT, _RIGHT = ([np.uint32(x) for x in xs] for xs in (_K, _SHIFTS, [32 - x for x in _SHIFTS]))


def _block(state: list[np.ndarray], words: list[np.ndarray | int]) -> list[np.ndarray]:
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[_WORDS[i]]
        if isinstance(word, int):
            np.add(f, np.uint32((_K[i] + word) & _MASK), out=f)
        else:
            np.add(f, _ADDED[i], out=f), np.add(f, word, out=f)
        np.add(f, a, out=f)
        np.left_shift(f, _LEFT[i], out=t), np.right_shift(f, _RIGHT[i], out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [np.add(x, y, out=x) for x, y in zip((a, b, c, d), state)]


class Digests:
    """The MD5 digests of prefix + text for each of some texts, for one prefix after the other."""

    def __init__(self, texts: pa.Array):
        """texts: strings without nulls."""
        raw = texts.cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        self._bytes = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        self._n, self._starts, self._sizes = len(raw), at[:-1], np.diff(at)
        self._laid: tuple[int, list] = (-1, [])

    def _lay_out(self, room: int) -> list:
        """(rows, words of their blocks, as they are behind a prefix of so many bytes that are 0), by number of blocks: a word that is the same in all rows is one number."""
        out, blocks = [], (room + self._sizes + 9 + 63) // 64
        for n in np.unique(blocks).tolist():
            rows = np.flatnonzero(blocks == n)
            text, sizes = np.zeros((len(rows), n * 64), np.uint8), self._sizes[rows]
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                text[of, room : room + size] = self._bytes[self._starts[rows[of]][:, None] + np.arange(size)]
            text[np.arange(len(rows)), room + sizes] = 0x80
            text.view("<u8")[:, -1] = (room + sizes) * 8
            words = [np.ascontiguousarray(w) for w in text.view("<u4").T.astype(np.uint32)]
            out.append((rows, [int(w[0]) if (w == w[0]).all() else w for w in words]))
        return out

    def words(self, prefixes: list[bytes]) -> np.ndarray:
        """Of prefixes of one length, (4, prefix, text): the numbers that the digests' hexadecimal digits 1 to 8, 9 to 16, 17 to 24 and 25 to 32 stand for. A few texts are as fast
        a piece as many only with several prefixes at a time."""
        room, m = len(prefixes[0]), len(prefixes)
        if self._laid[0] != room:
            self._laid = room, self._lay_out(room)
        heads = np.frombuffer(b"".join(p + bytes(-room % 4) for p in prefixes), "<u4").reshape(m, -1).astype(np.uint32)
        out = np.empty((4, m, self._n), np.uint32)
        for rows, laid in self._laid[1]:
            n = len(rows)
            words = [w if isinstance(w, int) else np.tile(w, m) for w in laid]
            for k, head in enumerate(heads.T):
                word = np.uint32(words[k]) if isinstance(words[k], int) else words[k]
                words[k] = int(word | head[0]) if m == 1 and isinstance(words[k], int) else word | np.repeat(head, n)
            state = [np.full(m * n, x, np.uint32) for x in _START]
            for k in range(0, len(words), 16):
                state = _block(state, words[k : k + 16])
            for k in range(4):
                out[k][:, rows] = state[k].reshape(m, n)
        return out.byteswap()
