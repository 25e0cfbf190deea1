"""Token counts of a unigram model by dynamic programming over tries.

A pre-token is a run of non-space characters with a space mark before it. Its
best segmentation is the one whose pieces have the greatest sum of scores; ties
go to fewer tokens. The best score of a prefix depends on the prefix alone, so
the distinct pre-tokens of many texts are put into a trie and each shared
prefix's forward score is computed once. Nodes that end a pre-token store its
number of tokens, and the texts look it up.

The trie is laid out by depth: all nodes of one depth are found at once as the
distinct prefix hashes, and their scores come from those of their up to
`longest` ancestors in numpy, so no Python loop runs over pre-tokens or nodes.
Pre-tokens of more than `DEEP` bytes, which share next to nothing past that
depth, are not put in: in slices of each, all pieces at all places are found at
once, and one pass over the slice's bytes takes the best scores along.

The model: the pieces of a public vocabulary, scored -ln(rank + 2) in
thousandths, and single bytes, which every text can fall back to, scored
`BYTE`. Pieces inside which a space mark stands, and byte pieces, are left out.

Defined results: null and blank texts have no tokens; rows with equal doc_id are
counted each; extra columns are ignored; an empty table gives an empty result.

Scale: one pass without a shuffle; a task holds one trie at a time, over about
`CHUNK` bytes of text, so memory does not grow with the input. A pre-token's
time is in proportion to its length, however long it is.
"""

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, text

MODEL, BYTE, CHUNK = "piece_bpe_32k.model", -25_000, 8 << 20
#: Bytes of a pre-token that goes into the trie at most, and of a slice of a longer one.
DEEP, SLICE = 128, 1 << 18
MARK = "▁"
#: A score and a number of tokens in one number that is compared at once.
WEIGHT = 1 << 24
SLOTS = 1 << 20


def vocabulary(path: str) -> dict[bytes, int]:
    """Scores of the pieces as bytes, the leading space mark as a space."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:] or piece == MARK:
            continue
        out[piece.replace(MARK, " ").encode()] = round(-1000 * math.log(i + 2))
    return out


class Model:
    """Piece scores behind hashes: one table looked up by the low bits, and a small one for the pieces that collide there."""

    def __init__(self, pieces: dict[bytes, int]):
        raw = list(pieces)
        ends = np.cumsum([len(p) for p in raw])
        starts = ends - [len(p) for p in raw]
        keys = text.hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        values = np.array(list(pieces.values()), np.int64)
        self.lengths = sorted({len(p) for p in raw} | {1})
        slot = keys & np.uint64(SLOTS - 1)
        _, own = np.unique(slot, return_index=True)
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
        rest = np.setdiff1d(np.arange(len(keys)), own)
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_values = keys[rest], values[rest]
        self.shared = np.zeros(SLOTS, bool)
        self.shared[slot[rest]] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the keys that are pieces, and their scores."""
        slot = keys & np.uint64(SLOTS - 1)
        hit = np.flatnonzero(self.keys[slot] == keys)
        value = self.values[slot[hit]]
        if len(self.more_keys):
            maybe = np.flatnonzero(self.shared[slot])
            where = np.minimum(np.searchsorted(self.more_keys, keys[maybe]), len(self.more_keys) - 1)
            good = self.more_keys[where] == keys[maybe]
            hit, value = np.r_[hit, maybe[good]], np.r_[value, self.more_values[where[good]]]
        return hit, value


def trie_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """Token counts of distinct pre-tokens, data[start:end] each, with a space put before.

    data must not be folded; prefixes are told apart by 64-bit hashes.
    """
    size = end - start + 1
    order = np.argsort(-size, kind="stable")  # the words that reach a depth come first
    start, size = start[order], size[order]
    depth_words = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), "right")
    up, _ = text.powers(int(size.max(initial=0)) + 1)
    longest = max(model.lengths)
    total = np.zeros(len(size), np.uint64)  # unnormalised hash of each word's prefix
    past_total = [total]
    past_best: list[np.ndarray] = [np.zeros(1, np.int64)]
    past_node = [np.zeros(len(size), np.int64)]
    counts = np.zeros(len(size), np.int64)
    byte = BYTE * WEIGHT - 1
    for depth in range(1, len(depth_words) + 1):
        n = depth_words[depth - 1]
        letter = np.full(n, 32, np.uint64) if depth == 1 else data[start[:n] + depth - 2].astype(np.uint64)
        total = total[:n] + (letter + np.uint64(1)) * up[depth - 1]
        _, first, node = np.unique(total, return_index=True, return_inverse=True)
        best = np.full(len(first), np.iinfo(np.int64).min)
        _, down = text.powers(depth + 1)
        for back in model.lengths:
            if back > depth:
                break
            before = past_total[-back][first]
            piece = text.mix((total[first] - before) * down[depth - back])
            ancestor = past_best[-back][past_node[-back][first]]
            if back == 1:
                best = ancestor + byte
            hit, value = model.find(piece)
            best[hit] = np.maximum(best[hit], ancestor[hit] + value * WEIGHT - 1)
        done = np.flatnonzero(size[:n] == depth)
        counts[done] = -best[node[done]] % WEIGHT
        for past, now in ((past_total, total), (past_best, best), (past_node, node)):
            past.append(now)
            if len(past) > longest:
                past.pop(0)
    out = np.zeros(len(size), np.int64)
    out[order] = counts
    return out


def long_count(data: np.ndarray, model: Model) -> int:
    """The token count of one pre-token of any length, with a space put before."""
    data = np.r_[np.uint8(32), data]
    longest = max(model.lengths)
    # best scores, and tokens with them, of the last prefixes: at i % longest that of i bytes
    score, tokens = [0] * longest, [0] * longest
    for lo in range(0, len(data), SLICE):
        hi = min(len(data), lo + SLICE)
        part = data[max(0, lo - longest + 1) : hi]
        shift = lo - max(0, lo - longest + 1)
        up, down = text.powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        ends, backs, values = [], [], []
        for back in model.lengths:
            if back > len(part):
                break
            hit, value = model.find(text.mix((total[back:] - total[:-back]) * down[: len(part) + 1 - back]))
            ends.append(hit + back - shift)
            backs.append(np.full(len(hit), back))
            values.append(value)
        end, back, value = (np.concatenate(x) for x in (ends, backs, values))
        order = np.argsort(end, kind="stable")
        order = order[np.searchsorted(end[order], 1) :]
        bounds = np.searchsorted(end[order], np.arange(1, hi - lo + 2)).tolist()
        back, value = back[order].tolist(), value[order].tolist()
        for i in range(lo + 1, hi + 1):
            before = (i - 1) % longest
            top, n = score[before] + BYTE, tokens[before] + 1
            for x in range(bounds[i - lo - 1], bounds[i - lo]):
                at = (i - back[x]) % longest
                own = score[at] + value[x]
                if own > top or own == top and tokens[at] + 1 < n:
                    top, n = own, tokens[at] + 1
            score[i % longest], tokens[i % longest] = top, n
    return tokens[len(data) % longest]


def counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """Token counts of distinct pre-tokens of any length."""
    out = np.zeros(len(start), np.int64)
    deep = end - start > DEEP
    out[~deep] = trie_counts(data, start[~deep], end[~deep], model)
    out[deep] = [long_count(data[a:b], model) for a, b in zip(start[deep].tolist(), end[deep].tolist(), strict=True)]
    return out


def count(path: str):
    """Task function: (doc_id, text) to (doc_id, n_pretokens, n_tokens)."""

    def run(batches):
        model = Model(vocabulary(path))
        for batch in batches:
            for c in text.chunks(batch.column(1), CHUNK):
                w = text.words(c.data, c.offsets, text.SPACE, lower=False)
                _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                each = counts(c.data, w.start[first], w.end[first], model)[back]
                sums = np.r_[0, np.cumsum(each)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), pa.array(np.diff(w.first)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]])], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of docs (doc_id long, text); model: a sentencepiece file."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(count(model), "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(jobs.read(spark, sf_dir, "documents"))
