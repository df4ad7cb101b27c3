"""Order-free pseudo-randomness: the first 52 bits of an MD5, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash52(*parts: Column | str) -> Column:
    """A long below 2^52 from the parts joined by '|'. Plain strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) from hash52."""
    return hash52(*parts).cast("double") / float(1 << 52)


def two_uniforms(*parts: Column | str) -> tuple[Column, Column]:
    """Two doubles in (0, 1), never 0 or 1, from the first and the next 52 bits of one MD5."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *columns).cast("binary"))
    first, second = ((F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for at in (1, 14))
    return first, second


def md5_52(words):
    """The first 52 bits of the MD5 of each word of an Arrow column without nulls, as hash52() has them, many words at a time; words over 55 bytes, which take more than one block, one by one."""
    import hashlib
    import math

    import numpy as np
    import pyarrow as pa

    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], dtype="<i4")[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(ends).astype(np.int64)
    out, whole = np.empty(len(words), dtype=np.int64), np.flatnonzero(sizes <= 55)
    for at in np.flatnonzero(sizes > 55).tolist():
        out[at] = int.from_bytes(hashlib.md5(words[at].as_py(), usedforsecurity=False).digest()[:7]) >> 4
    turns = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
    sines = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
    places = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    for first in range(0, len(whole), 8_192):
        own = whole[first : first + 8_192]
        n = len(own)
        row = np.arange(n, dtype=np.int64) * 64
        inside = np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        block = np.zeros(n * 64, dtype=np.uint8)
        block[np.repeat(row, sizes[own]) + inside] = data[np.repeat(ends[own].astype(np.int64), sizes[own]) + inside]
        block[row + sizes[own]] = 0x80
        parts = np.ascontiguousarray(block.view("<u4").reshape(n, 16).T)
        parts[14] = sizes[own] * 8
        a, b, c, d = (np.full(n, x) for x in start)
        for i in range(64):
            mixed = ((c ^ d) & b) ^ d if i < 16 else ((b ^ c) & d) ^ c if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            mixed += a
            mixed += parts[places[i]]
            mixed += sines[i]
            high = mixed >> np.uint32(32 - turns[i])
            mixed <<= np.uint32(turns[i])
            mixed |= high
            mixed += b
            a, d, c, b = d, c, b, mixed
        left, right = ((x + y).byteswap().astype(np.int64) for x, y in ((a, start[0]), (b, start[1])))
        out[own] = left << 20 | right >> 12
    return out
