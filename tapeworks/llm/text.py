"""Words of many texts at once, as numpy arrays over UTF-8 bytes.

A batch of texts is cut into chunks of about a megabyte of whole texts, and
each chunk is turned into word boundaries and 64-bit word hashes without a
Python loop over words. Multi-byte characters never contain an ASCII byte, so
classes of ASCII separators can be read off the bytes.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
ODD = np.array([(0xD1342543DE82EF95 * (2 * i + 1) + 0x632BE59BD9B4E019 * i) & (2**64 - 1) | 1 for i in range(64)], np.uint64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of `[^\x20\x09-\x0D]+`, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` and of runs of letters.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
PUNCT = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NOT_LETTER = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    start: np.ndarray  # its first byte in the chunk
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words


class Chunk(NamedTuple):
    rows: slice  # of the batch
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of each text, and the end


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Whole texts, together of about limit bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, made: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i below n at least; grown as texts ask for it."""
    size = 1 << max(19, (n - 1).bit_length())
    if made.get("size", 0) < size:
        made["up"], made["down"] = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))))
        made["size"] = size
    return made["up"], made["down"]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of non-separator bytes; none spans two texts."""
    n = len(data)
    data = LOWER[data] if lower else data
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(hash_spans(data, start, end), start, end, np.searchsorted(start, offsets))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from each position on; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * ODD[0]
    for j in range(1, k):
        out = out + hashes[j : n + j] * ODD[j]
    return mix(out + np.uint64(k))


def room(first: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from there on."""
    count = np.diff(first)
    return np.repeat(first[1:], count) - np.arange(first[-1])


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text in the chunk."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def minimisers(gram: np.ndarray, w: int, left: np.ndarray, k: int) -> np.ndarray:
    """For each position, that of the leftmost least gram among the w from it on, or -1.

    left is room(): a position counts if its k + w - 1 words lie in its text.
    """
    n = len(gram) - w + 1
    out = np.full(len(left), -1, np.int64)
    if n > 0:
        at = np.lib.stride_tricks.sliding_window_view(gram, w).argmin(axis=1) + np.arange(n)
        good = left[:n] >= k + w - 1
        out[:n][good] = at[good]
    return out


def bitmap(bits: int) -> np.ndarray:
    return np.zeros(1 << (bits - 3), np.uint8)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; its upper bits choose the bit."""
    bits = np.uint64(64 - len(bitmap).bit_length() + 1 - 3)
    slot = hashes >> bits
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def set_bits(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    slot = hashes >> np.uint64(64 - len(bitmap).bit_length() + 1 - 3)
    np.bitwise_or.at(bitmap, slot >> np.uint64(3), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array that takes counts[i] values for its i-th list."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
