"""Deterministic hash draws.

``h(seed, tag, *ids)`` is the first 60 bits of md5 over the pipe-joined text of
its parts. It does not depend on partitioning, retries or the number of bags, so
every sample, bag and split can be recomputed anywhere (no ``rand()`` in plans
that may be re-executed after an executor loss). The same text is computable in
any SQL engine with md5, which is what the oracle checks rely on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 60 hash bits, and 2^60 as the divisor that maps h to [0, 1).
HASH_BITS = 60
TWO_POW_60 = float(2 ** 60)


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    if isinstance(p, str) and p.startswith("@"):
        return F.col(p[1:]).cast("string")
    return F.lit(str(p))


def hash_text(*parts) -> Column:
    """Pipe-joined text of the parts. Strings starting with '@' name columns."""
    return F.concat_ws("|", *[_part(p) for p in parts])


def h(*parts) -> Column:
    """60-bit non-negative bigint hash of the parts (see module doc)."""
    return F.conv(F.substring(F.md5(hash_text(*parts)), 1, 15), 16, 10).cast("bigint")


def uniform(hcol: Column) -> Column:
    """Map a 60-bit hash to a double in [0, 1)."""
    return hcol.cast("double") / F.lit(TWO_POW_60)


# Fixed values of md5: shifts of the four rounds, words they take, sines and first state.
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Fixed value: messages hashed at once, so that the state stays in a core's cache.
_AT_ONCE = 1 << 14


def _md5_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the md5 of messages that are padded to whole blocks: (16 x blocks, messages) of uint32."""
    n = words.shape[1]
    state = [np.full(n, v, dtype=np.uint32) for v in _FIRST]
    f, t = np.empty((2, n), dtype=np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
                f ^= d
            elif turn == 1:
                np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
                f ^= c
            elif turn == 2:
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            else:
                np.bitwise_or(np.bitwise_not(d, out=f), b, out=f)
                f ^= c
            a += f
            step, first = _WORDS[turn]
            a += words[at + (step * i + first) % 16]
            a += np.uint32(_SINES[i])
            left = _SHIFTS[turn][i % 4]
            np.right_shift(a, np.uint32(32 - left), out=t)
            a <<= np.uint32(left)
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for v, new in zip(state, (a, b, c, d)):
            v += new
    return state[0], state[1]


def numbered_hash(starts: list[bytes], of: np.ndarray, number: np.ndarray) -> np.ndarray:
    """``h`` of texts that end in a whole number from 0: of each row, the start that ``of`` names and its ``number``.
    All rows of one length are hashed together, so a row costs a small part of what it costs in SQL."""
    out = np.empty(len(of), dtype=np.int64)
    length = np.array([len(v) for v in starts])[of]
    digits = np.ones(len(of), dtype=np.int64)
    for k in range(1, len(str(int(number.max(initial=0))))):
        digits += number >= 10 ** k
    for size in np.unique(length).tolist():
        names = [k for k, v in enumerate(starts) if len(v) == size]
        place = np.zeros(len(starts), dtype=np.int64)
        place[names] = np.arange(len(names))
        table = np.frombuffer(b"".join(starts[k] for k in names), dtype=np.uint8).reshape(len(names), size)
        for k in np.unique(digits[length == size]).tolist():
            every = np.flatnonzero((length == size) & (digits == k))
            whole = size + k
            blocks = (whole + 8) // 64 + 1
            for at in range(0, len(every), _AT_ONCE):
                rows = every[at:at + _AT_ONCE]
                text = np.zeros((len(rows), 64 * blocks), dtype=np.uint8)
                text[:, :size] = table[place[of[rows]]]
                rest = number[rows]
                for j in range(whole - 1, size - 1, -1):
                    shorter = rest // 10  # numpy divides by one number faster than it takes both results
                    text[:, j] = rest - 10 * shorter + 48
                    rest = shorter
                text[:, whole] = 128
                text[:, -8:] = np.frombuffer((8 * whole).to_bytes(8, "little"), dtype=np.uint8)
                a, b = (v.byteswap().astype(np.int64) for v in _md5_words(np.ascontiguousarray(text.view("<u4").T)))
                out[rows] = (a << 28) | (b >> 4)
    return out


def key_text(key_cols: list[str]) -> Column:
    """Text identity of a (possibly composite) key."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])


def as_list(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)
