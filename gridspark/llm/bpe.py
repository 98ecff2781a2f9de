"""Byte-level BPE encoding and decoding with a public tokenizer's ranks.

Spark splits each whole text into the pattern's matches; every batch of matches is reduced to its distinct words, whose
byte arrays are folded by ranked merges (always the lowest-ranked neighbouring pair, the leftmost on ties) and laid out
again.  The rank map is a fixed literal of the tokenizer, sent out once.  Decoding joins the ids' binary pieces.
``encode_words`` is the same fold written with Spark's higher-order functions.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import once

NONE = np.int32(2**31 - 1)
LONG = 256  # bytes from which a word is merged with a heap instead of a matrix
SLICE = 250_000  # words laid out at once
DECODED = 256  # documents that are decoded and handed on together


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """The fold over many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[int(k)] for k in self.keys], np.int32)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_length)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def fold(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their final tokens) of a matrix of words of equal length; each round merges one pair of every open row."""
        rows = np.arange(len(tokens))
        ranks = self.rank(tokens[:, :-1], tokens[:, 1:]) if tokens.shape[1] > 1 else np.empty((len(tokens), 0), np.int32)
        while len(rows):
            if ranks.shape[1] == 0:
                yield rows, tokens
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                yield rows[done], tokens[done]
                rows, tokens, ranks, at, best = rows[~done], tokens[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    return
            each, width = np.arange(len(rows)), tokens.shape[1]
            tokens[each, at] = best
            stay = np.arange(width - 1)[None, :]
            tokens = np.take_along_axis(tokens, stay + (stay > at[:, None]), axis=1)
            stay = stay[:, : width - 2]
            ranks = np.take_along_axis(ranks, stay + (stay >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.rank(tokens[left, at[left] - 1], tokens[left, at[left]])
            ranks[right, at[right]] = self.rank(tokens[right, at[right]], tokens[right, at[right] + 1])

    def long_word(self, word: bytes) -> list[int]:
        """The same merges for one long word, with a heap over a linked list."""
        tokens: list[int] = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tokens)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := self.pairs.get(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or tokens[i] != a or tokens[j] != b:
                continue
            tokens[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (s := self.pairs.get(tokens[k] << 32 | tokens[after[k]])) is not None:
                    heapq.heappush(heap, (s, k, tokens[k], tokens[after[k]]))
        return [t for t, live in zip(tokens, alive, strict=True) if live]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids) for distinct words: word i has ids[start[i] : start[i] + length[i]]."""
        words = words.cast(pa.binary())
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.empty(0, np.uint8)
        size, start, length = np.diff(offsets), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out, at = [], 0
        whole = np.array([self.ranks.get(w, -1) for w in words.to_pylist()], np.int64)
        known = np.flatnonzero(whole >= 0)
        start[known], length[known] = np.arange(len(known)), 1
        out.append(whole[known].astype(np.int32))
        at = len(known)
        open_ = whole < 0
        for n in np.unique(size[open_]):
            of = np.flatnonzero(open_ & (size == n))
            if n == 0:
                continue
            if n > LONG:
                for i in of:
                    ids = self.long_word(raw[offsets[i] : offsets[i] + n].tobytes())
                    start[i], length[i] = at, len(ids)
                    out.append(np.array(ids, np.int32))
                    at += len(ids)
                continue
            for rows, tokens in self.fold(self.byte[raw[offsets[of][:, None] + np.arange(n)[None, :]]]):
                k, width = tokens.shape
                start[of[rows]], length[of[rows]] = at + np.arange(k) * width, width
                out.append(tokens.ravel())
                at += k * width
        return start, length, np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.piece_bytes, self.piece_start[ids], self.piece_length[ids]).tobytes()


_ready: dict[str, Merger] = {}


def _merger(shared) -> Merger:
    """The broadcast ranks' tables, built once in a worker process."""
    name, ranks = shared.value
    if name not in _ready:
        _ready.clear()
        _ready[name] = Merger(ranks)
    return _ready[name]


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] of every i, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(start - ends + length, length)]


def _encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared)
        for batch in batches:
            lists = batch.column("_words")
            offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            row = 0
            while row < len(lists):  # documents that have up to SLICE words together
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
                coded = lists.values.slice(offsets[row], offsets[end] - offsets[row]).dictionary_encode()
                start, length, ids = merger.encode(coded.dictionary)
                index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(length[index])]) if len(index) else np.zeros(1, np.int64)
                flat = _gather(ids, start[index], length[index]).astype("<u4") if len(index) else np.empty(0, "<u4")
                cuts = ends[offsets[row : end + 1] - offsets[row]]
                blobs = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_rest"), pa.array(blobs, pa.binary())], names=["_id", "_rest", "_ids"])
                row = end

    return run


def _decode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared)
        for batch in (b.slice(i, DECODED) for b in batches for i in range(0, b.num_rows, DECODED)):
            done = [merger.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_rest"), batch.column("_ids"), pa.array(done, pa.binary())], names=["_id", "_rest", "_ids", "_bytes"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, and ids: the token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids.  Ties between equal pairs go to the leftmost.  Words of any length are merged in
    n log n.  Rows that repeat pass through.  Other columns stay, whatever their names (an ids column is replaced).
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, "ids")]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    words = F.coalesce(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit("(?U)" + pattern), F.lit(0)), F.array().cast("array<string>"))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), struct.alias("_rest"), words.alias("_words"))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks))
    kind = dict(own.dtypes)
    out = own.mapInArrow(_encode_batches(shared), f"_id {kind['_id']}, _rest {kind['_rest']}, _ids binary")
    return out.select(F.col("_id").alias(id_col), *[F.col("_rest").getField(c).alias(c) for c in rest], F.col("_ids").alias("ids"))


def decode(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """tokens and decoded: the bytes that the ids stand for; null ids decode to no bytes."""
    rest = [c for c in tokens.columns if c not in (id_col, ids_col, "decoded")]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    own = tokens.select(F.col(f"`{id_col}`").alias("_id"), struct.alias("_rest"), F.col(f"`{ids_col}`").alias("_ids"))
    shared = tokens.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks))
    kind = dict(own.dtypes)
    out = own.mapInArrow(_decode_batches(shared), f"_id {kind['_id']}, _rest {kind['_rest']}, _ids binary, _bytes binary")
    return out.select(F.col("_id").alias(id_col), *[F.col("_rest").getField(c).alias(c) for c in rest], F.col("_ids").alias(ids_col), F.col("_bytes").alias("decoded"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], col: str = "word", buckets: int = 8192) -> DataFrame:
    """words and ids array<int>, by higher-order functions alone: a fold of ranked merges over each word's bytes.

    The rank map is a literal, cut into buckets by hash because a map literal is searched from its start.
    """
    spark = words.sparkSession
    keys = spark.createDataFrame([(k.hex().upper(), v) for k, v in ranks.items()], "k string, v int")
    cells: list[dict[str, int]] = [{} for _ in range(buckets)]
    for b, k, v in keys.select(F.pmod(F.xxhash64("k"), F.lit(buckets)), "k", "v").collect():
        cells[b][k] = v
    literal = F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")

    def rank(k: Column) -> Column:
        return F.coalesce(F.try_element_at(F.element_at(literal, (F.pmod(F.xxhash64(k), F.lit(buckets)) + 1).cast("int")), k), F.lit(int(NONE)))

    hexed = F.hex(F.col(col))
    size = F.octet_length(F.col(col))
    pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))

    def pair_ranks(p: Column) -> Column:
        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1))))).otherwise(F.array(F.lit(int(NONE))))

    def join_at(p: Column, at: Column) -> Column:
        return F.concat(F.slice(p, F.lit(1), at - 1), F.array(F.concat(F.element_at(p, at), F.element_at(p, at + 1))), F.slice(p, at + 2, F.size(p)))

    def merge(p: Column, _: Column) -> Column:
        at = lambda found: F.array_position(found, F.array_min(found)).cast("int")
        return once(pair_ranks(p), lambda found: F.when(F.array_min(found) == int(NONE), p).otherwise(once(at(found), lambda k: join_at(p, k))))

    folded = F.when(rank(hexed) != int(NONE), F.array(hexed)).otherwise(F.aggregate(F.sequence(F.lit(1), size), pieces, merge))
    return words.withColumn("ids", F.when(size > 0, F.transform(folded, rank)).otherwise(F.array().cast("array<int>")))
