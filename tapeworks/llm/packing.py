"""Packing documents into sequences along a space-filling curve.

A document's vector is the mean of hashed random signs of its tokens, in a few
dimensions. The quantised vectors lie on a Hilbert curve, and documents are
range-sorted by their place on it, so that neighbours along the curve, which
are alike, share sequences. Each sorted partition is packed from its beginning:
every sequence gets exactly `length` tokens and a document that does not fit is
cut. What is left at a partition's end goes to sequences whose lengths are
powers of two, which need no padding, so nothing is padded at all.

Defined results: a null text counts as empty; every document ends with the
token `end`, so an empty one has one token; rows with equal doc_id are packed
as documents of their own; extra columns are ignored; an empty table gives no
pieces. Which documents neighbour each other depends on how Spark partitions
the sort; every id lies in exactly one piece in any case. sequence_id is the
partition's number times 2**32 and the sequence's number in it.

Scale: texts are tokenised where they are read; only ids are shuffled (two
bytes each for vocabularies below 65,536), once, by range. Each partition packs
itself as a stream.
"""

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import jobs, text

LENGTH, END, DIMS, BITS = 1024, 0, 4, 8
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Bytes that begin no character outside ASCII and U+00C0 to U+017F, for which both libraries agree on letters.
COMMON = text.byte_class((0x09, 0x0D), (0x20, 0x7E), (0x80, 0xBF), (0xC3, 0xC5))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts by one public vocabulary, with the faster of two libraries where they agree."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, special: str = "<|endoftext|>"):
        self.tokenizer, self.special = tokenizer, special
        self.held = self.fast = None
        if ranks:
            import base64

            with open(ranks, "rb") as f:
                held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def encode(self, raw: bytes, data: np.ndarray) -> list[int]:
        value = raw.decode()
        if self.fast and COMMON[data].all() and self.special not in value:
            return self.fast.encode_ordinary(value)
        return self.whole().encode(value, add_special_tokens=False).ids

    def whole(self) -> Tokenizer:
        """The full tokenizer, loaded when a text first asks for it."""
        if self.held is None:
            self.held = Tokenizer.from_file(self.tokenizer)
        return self.held

    def size(self) -> int:
        """A bound of the ids, the special one included."""
        return self.fast.max_token_value + 2 if self.fast else self.whole().get_vocab_size(with_added_tokens=True)


def encoder(tokenizer: str, ranks: str | None, pattern: str | None, made: dict = {}) -> Encoder:  # noqa: B006
    """One for each Python worker."""
    if (tokenizer, ranks) not in made:
        made[tokenizer, ranks] = Encoder(tokenizer, ranks, pattern)
    return made[tokenizer, ranks]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (n, dims) of integers below 2**bits (Skilling, 2004)."""
    x = x.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            hit = x[i] & q != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[i] >> b & 1)
    return place


def curve_keys(ids: np.ndarray, first: np.ndarray, signs: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert places of documents; first: where each one's ids begin, then the end."""
    count = np.maximum(np.diff(first), 1)
    total = np.stack([np.add.reduceat(s[ids], first[:-1]) for s in signs.T], axis=1)
    share = np.tanh(total / count[:, None] * 4) * 0.5 + 0.5  # means of signs seldom leave a quarter
    return hilbert(np.clip((share * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def tokens(tokenizer: str, ranks: str | None, pattern: str | None, end: int, dims: int, bits: int):
    """Task function: (doc_id, text) to (doc_id, place, n_tokens, ids)."""

    def run(batches):
        own = encoder(tokenizer, ranks, pattern)
        vocabulary = own.size()
        kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (max(vocabulary, end + 1), dims))
        for batch in batches:
            for c in text.chunks(batch.column(1)):
                raw = c.data.tobytes()
                held = [np.array([*own.encode(raw[a:b], c.data[a:b]), end], kind) for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)]
                first = np.r_[0, np.cumsum([len(x) for x in held])]
                place = curve_keys(np.concatenate(held), first, signs, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), pa.array(place), pa.array(np.diff(first)), pa.array([x.tobytes() for x in held], pa.binary())], ["doc_id", "place", "n_tokens", "ids"])

    return run


def tail(left: int) -> list[int]:
    """The powers of two that left is the sum of, greatest first."""
    return [1 << i for i in range(left.bit_length() - 1, -1, -1) if left >> i & 1]


def fill(length: int, keep_ids: bool):
    """Task function: sorted (doc_id, n_tokens, ids) to pieces."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        at, pieces = 0, []  # tokens so far; pieces of the sequence that is being filled

        def row(doc, start, ids, total, sequence, offset):
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            return (doc, start, len(ids), crc, total, sequence, offset, *([ids.astype(np.int32).tolist()] if keep_ids else []))

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
        whole = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            out = []
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, start = np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}")), 0
                while start < n:
                    size = min(n - start, length - at % length)
                    pieces.append((doc, start, ids[start : start + size], n))
                    start, at = start + size, at + size
                    if at % length == 0:
                        offset = 0
                        for doc_, start_, part, n_ in pieces:
                            out.append(row(doc_, start_, part, n_, base + at // length - 1, offset))
                            offset += len(part)
                        pieces = []
            yield whole(out)
        out, sequence = [], base + at // length
        sizes = tail(at % length)
        offset = 0
        for doc, start, part, n in pieces:
            while len(part):
                size = min(len(part), sizes[0] - offset)
                out.append(row(doc, start, part[:size], n, sequence, offset))
                start, part, offset = start + size, part[size:], offset + size
                if offset == sizes[0]:
                    sizes, sequence, offset = sizes[1:], sequence + 1, 0
        yield whole(out)

    return run


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text).

    tokenizer: a tokenizers file, by default the public byte-level one. ranks
    and pattern: the same vocabulary for tiktoken, used where both agree.
    keep_ids adds each piece's ids.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks, pattern = tokenizer_path(TOKENIZER), tokenizer_path(RANKS), public_tokenizers.PATTERN
    jobs.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = jobs.cut(docs.mapInArrow(tokens(tokenizer, ranks, pattern, end, DIMS, BITS), "doc_id bigint, place bigint, n_tokens bigint, ids binary"))
    order = ["place", "doc_id", "n_tokens"]
    along = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    return along.mapInArrow(fill(length, keep_ids), PIECES + (", ids array<int>" if keep_ids else ""))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(jobs.read(spark, sf_dir, "documents"), keep_ids=False)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, with their ids.

    A null text counts as empty; rows are packed each, whatever their doc_id;
    other columns are left behind; an empty table gives no pieces.
    """
    return pack(docs)
