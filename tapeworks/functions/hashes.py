"""64-bit FNV-1a, in Python and as column expressions.

Columns hold the value as two halves of 32 bits, since products of 64 bits
would overflow. Fixed values: the basis and the prime, 2**40 + 0x1B3.
"""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, start: int = BASIS) -> int:
    for b in data:
        start = (start ^ b) * PRIME & (1 << 64) - 1
    return start


def fnv1a_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each data[start:end] (bytes as uint8): all pieces go on by a byte at a time, those that have ended drop out."""
    value, length = np.full(len(start), BASIS, np.uint64), end - start
    order = np.argsort(-length, kind="stable")
    first, ends = start[order], length[order]
    with np.errstate(over="ignore"):
        for i in range(int(ends[0]) if len(ends) else 0):
            n = int(np.searchsorted(-ends, -i, side="left"))
            value[:n] = (value[:n] ^ data[first[:n] + i].astype(np.uint64)) * np.uint64(PRIME)
    out = np.empty_like(value)
    out[order] = value
    return out


def text_hash(text: Column) -> Column:
    """(hi, lo) of the hash of a text's bytes."""
    start = F.struct(F.lit(BASIS >> 32).alias("hi"), F.lit(BASIS & 0xFFFFFFFF).alias("lo"))
    data = F.hex(F.encode(text, "UTF-8"))
    half = 0xFFFFFFFF

    def step(h, i):
        low = h["lo"].bitwiseXOR(F.conv(F.substring(data, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
        small = low * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(small, 32) + low * 256
        return F.struct(high.bitwiseAND(half).alias("hi"), small.bitwiseAND(half).alias("lo"))

    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), (F.length(data) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def modulo(h: Column, n: int) -> Column:
    """The unsigned hash modulo n, up to 2**20."""
    return (h["hi"] % n * ((1 << 32) % n) + h["lo"] % n) % n


def as_hex(h: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(h[p]), 8, "0") for p in ("hi", "lo"))))
