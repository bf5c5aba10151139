"""Engine-independent hashes: md5 text, so that any SQL engine can repeat a split or a bit position."""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts: Column) -> Column:
    """md5 of the parts joined by '|', as 32 hex digits."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_int(text: Column) -> Column:
    """The first seven hex digits of md5(text) as a BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


# Fixed values of RFC 1321: additive constants, rotations, initial state.
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Strings hashed at a time, so that their words stay in the cache, and the longest string of one md5 block.
_AT_A_TIME, _ONE_BLOCK = 1 << 13, 55


def _first_word(raw: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5 of every row, all of one length of at most 55 bytes, as it stands in the state."""
    n, length = raw.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :length], block[:, length] = raw, 0x80
    words, used = np.ascontiguousarray(block.view("<u4").T), length // 4 + 1
    a, b, c, d = (np.full(n, x, np.uint32) for x in _STATE)
    t = np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds leave the first word as it is
        quarter, add = i // 16, _SINES[i]
        k = (i, 5 * i + 1, 3 * i + 5, 7 * i)[quarter] % 16
        if quarter == 0 or quarter == 1:
            x, y, z = (b, c, d) if quarter == 0 else (d, b, c)
            np.bitwise_xor(y, z, t)
            t &= x
            t ^= z
        elif quarter == 2:
            np.bitwise_xor(b, c, t)
            t ^= d
        else:
            np.invert(d, t)
            t |= b
            t ^= c
        a += t
        if k < used:
            a += words[k]
        a += np.uint32((add + 8 * length if k == 14 else add) & 0xFFFFFFFF)
        turn = _TURNS[quarter][i % 4]
        np.left_shift(a, turn, t)
        a >>= 32 - turn
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return b + np.uint32(_STATE[0])


def hash_ints(raw: bytes | np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``hash_int`` of the stretches of a byte string that begin at ``start``, without a Python step per stretch: those of one
    length are hashed together, column by column. Stretches of more than one md5 block go one by one."""
    data, out = np.frombuffer(raw, np.uint8), np.empty(len(start), np.int64)
    size = np.minimum(length, _ONE_BLOCK + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    ends = np.cumsum(np.bincount(size, minlength=_ONE_BLOCK + 2)).tolist()
    for n, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
        if n > _ONE_BLOCK:
            for k in order[low:high].tolist():
                out[k] = int.from_bytes(md5(data[start[k] : start[k] + length[k]]).digest()[:4], "big") >> 4
            break
        for i in range(low, high, _AT_A_TIME):
            some = order[i : min(i + _AT_A_TIME, high)]
            out[some] = _first_word(data[start[some, None] + np.arange(n)]).byteswap() >> 4
    return out
