"""The first four bytes of MD5 digests of short texts, for whole columns of numbers in numpy: what deals rows to batches takes one for each row and epoch."""

from __future__ import annotations

import hashlib

import numpy as np

_ADDED = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_POWERS = 10 ** np.arange(1, 19)

#: Rows that are hashed together: enough to outweigh numpy's calls, few enough for the cache.
_ROWS = 32_768


def _first_word(words: list) -> np.ndarray:
    """First word of the digests of single blocks: sixteen words each, a column where rows differ and a number where they don't."""
    n = len(words[0])
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_ADDED[i] + word) % 2**32)
        turn = _TURNS[kind][i % 4]
        np.right_shift(a, np.uint32(32 - turn), out=low)
        a <<= np.uint32(turn)
        a |= low
        a += b
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0])


def md5_heads(ids, tails: list[str]) -> np.ndarray:
    """First four bytes, as numbers, of the MD5 digests of each id's text with a tail behind it: a row for each tail. Ids are an array of whole numbers or a list of texts."""
    ends = [tail.encode() for tail in tails]
    if not isinstance(ids, np.ndarray):
        texts = [str(i).encode() for i in ids]
        return np.array([[int.from_bytes(hashlib.md5(text + end).digest()[:4], "big") for text in texts] for end in ends], np.int64).reshape(len(ends), len(texts))
    out = np.empty((len(ends), len(ids)), np.int64)
    # By number of digits. Numbers with a sign, and texts longer than a block, are hashed one by one.
    size = np.where(ids < 0, 0, np.searchsorted(_POWERS, ids, side="right") + 1)
    longest = max(map(len, ends), default=0)
    for digits in np.unique(size).tolist():
        where = np.flatnonzero(size == digits)
        if not digits or digits + longest > 55:
            out[:, where] = md5_heads(ids[where].tolist(), tails)
            continue
        for at in range(0, len(where), _ROWS):
            part = where[at : at + _ROWS]
            block, rest = np.zeros((len(part), 4 * ((digits + longest) // 4 + 1)), np.uint8), ids[part]
            for j in range(digits - 1, -1, -1):
                tenth = rest // 10
                block[:, j] = rest - 10 * tenth + 48
                rest = tenth
            for k, end in enumerate(ends):
                length = digits + len(end)
                block[:, digits:] = np.frombuffer((end + b"\x80").ljust(block.shape[1] - digits, b"\0"), np.uint8)
                words = list(block.view("<u4").T.copy())
                words += [0] * (14 - len(words)) + [8 * length, 0]
                out[k, part] = _first_word(words).byteswap()
    return out
