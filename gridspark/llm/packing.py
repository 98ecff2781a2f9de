"""Best-fit packing of documents' tokens into sequences, certified by lower bounds.

Documents are dealt to partitions, each packed by best-fit decreasing.  Dual-feasible functions bound a partition's
number of sequences from below: where the packing reaches its bound it is certified.  Partitions with a gap give up the
documents of all sequences with room, certified ones those of their emptiest sequence; these are exchanged (dealt anew)
and packed again, until the whole packing reaches the bound of all lengths together or two exchanges save nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize
from gridspark.llm.segments import Memo, Ragged, flat, gather, split

GROUP = 32_768  # pieces that are packed together
ROUNDS = 8  # exchanges at most
JOINED = 50  # segments encoded as one text
PATIENCE = 2  # exchanges one after the other that may save nothing


class Vocabulary:
    """A byte-level vocabulary's ids of distinct segments."""

    def __init__(self, path: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(entries.values()) + 1, np.int64)
        for entry, i in entries.items():
            self.size[i] = len(entry)  # a sign of an entry stands for a byte
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _joins(self, segment: str) -> bool:
        last = segment[-1]
        return segment[0] == " " and (" " < last < "\x7f" or last.isalpha()) and not any(x in segment for x in self.special)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments, one after the other; each one's number of ids).

        Segments from a space to a visible sign are encoded JOINED at a time, as their tokens don't depend on their
        neighbours, and told apart by their tokens' bytes.
        """
        inner = np.array([self._joins(s) for s in segments], bool)
        some = [s for s, k in zip(segments, inner.tolist(), strict=True) if k]
        ids, _ = self._ids(["".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)])
        ends, borders = np.cumsum(self.size[ids]), np.cumsum([len(s.encode()) for s in some], dtype=np.int64)
        at = np.searchsorted(ends, borders, "right")
        if len(some) and not (at[-1] == len(ids) and (ends[at - 1] == borders).all()):
            return self._ids(segments)
        others, n_others = self._ids([s for s, k in zip(segments, inner.tolist(), strict=True) if not k])
        length, start = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        length[inner], length[~inner] = np.diff(at, prepend=0), n_others
        start[inner], start[~inner] = at - length[inner], len(ids) + np.cumsum(n_others) - n_others
        return gather(np.concatenate([ids, others]), start, length), length


class _Ids:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.ids = vocabulary, Ragged(np.uint32)

    def add(self, segments: list[str]) -> None:
        self.ids.add(*self.vocabulary.encode(segments))


_ready: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    if path not in _ready:
        vocabulary = Vocabulary(path, plain=False)
        _ready[path] = Memo(lambda: _Ids(vocabulary))
    return _ready[path]


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, row = _memo(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("_text")
            distinct, index, cuts = split(texts)
            slots = memo.slots(distinct)
            ids, length = memo.tables.ids.of(slots[index])
            ends = np.concatenate([[0], np.cumsum(length)])[cuts]
            # every document's ids with the end id after them
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
            ends += np.arange(len(ends))
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for i, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                first = (high - low - 1) % size + 1
                for k, b in enumerate(range(low + first, high + 1, size)):
                    a = max(low, b - size)
                    rows.append(i)
                    pieces.append(k)
                    starts.append(a - low)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].data))
            own = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(own)), batch.column("_rest").take(pa.array(own)), pa.array(row + own), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["_id", "_rest", "row", "piece", "start", "length", "ids_crc32"],
            )
            row += len(texts)

    return run


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room of its bin) of every length, by best-fit decreasing; equal lengths in their order.

    Bins are kept by their room; the bits of one number say which rooms there are, so the tightest fit is its lowest bit.
    """
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offset, room, there = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], 0
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = there >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            at = by_room[left].pop()
            if not by_room[left]:
                there ^= 1 << left
        else:
            left, at = size, len(room)
            room.append(size)
        bins[k], offset[k] = at, size - left
        room[at] = left = left - n
        by_room[left].append(at)
        there |= 1 << left
    return bins, offset, np.array(room, np.int64)[bins] if len(room) else bins


def least_bins(counts: np.ndarray, size: int) -> int:
    """A lower bound of the bins of ``size`` for counts[n] pieces of n, by dual-feasible functions in whole numbers.

    Of three families: staircases u(k), which round up to k + 1 equal steps; U(e), which takes pieces above size - e as
    whole bins and leaves those below e out; and the roundings to multiples of e that give large pieces what small ones lose.
    """
    n = np.flatnonzero(counts)
    if not len(n):
        return 0
    c = counts[n].astype(np.int64)
    best = -(-int((c * n).sum()) // size)
    for k in range(1, 100):
        value = np.where((k + 1) * n % size == 0, k * n, (k + 1) * n // size * size)
        best = max(best, -(-int((c * value).sum()) // (k * size)))
    for e in range(1, size // 2 + 1):
        best = max(best, -(-int((c * np.where(n > size - e, size, np.where(n < e, 0, n))).sum()) // size))
        m = size // e
        value = np.where(2 * n > size, 2 * (m - (size - n) // e), np.where(2 * n == size, m, 2 * (n // e)))
        best = max(best, -(-int((c * value).sum()) // (2 * m)))
    return best


def _pack(columns: list[str], size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offset, room = best_fit(lengths, size)
        used = int(bins.max()) + 1
        return group[columns].assign(bin=bins, offset=offset, room=room, bins=used, gap=used - least_bins(np.bincount(lengths, minlength=size + 1), size), emptiest=room == room.max())

    return run


def tokens(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' other columns with row, piece, start, length, ids_crc32: a row for each piece of a document's tokens and end_id.

    Only documents above ``size`` are cut, so that all their pieces but the first have ``size`` tokens.  Null texts count
    as empty and have the end id alone; every row is a document, whatever its id.  The vocabulary's own special tokens in
    a text are special, as in its library.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), struct.alias("_rest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    kind = dict(own.dtypes)
    return own.mapInArrow(_cut(path, size, end_id), f"_id {kind['_id']}, _rest {kind['_rest']}, row long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 2048, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """pieces (row, piece, length, ...; row and piece tell them apart) with sequence_id and offset.

    Every length must be 1 to ``size``.  Packed tables are written to the shared folder, round by round; the driver holds
    at most ``size`` counts.  The same pieces are packed in the same way.  An empty table gives an empty one.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", bin long, offset long, room long, bins long, gap long, emptiest boolean"
    counts = np.zeros(size + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    least = least_bins(counts, size)

    def packed(some: DataFrame, total: int, k: int) -> DataFrame:
        parts = max(1, -(-total // (group << min(k, 2))))  # an exchange packs up to four times as many together
        dealt = some.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(k)), F.lit(parts)))
        out = dealt.groupBy("part").applyInPandas(_pack([*columns, "part"], size), schema + ", part long")
        return materialize(out.withColumn("sequence_id", F.lit(k << 58).bitwiseOR(F.shiftleft("part", 24)).bitwiseOR(F.col("bin"))), "packed")

    def bins(of: DataFrame) -> int:
        return of.agg(F.count_distinct("sequence_id")).first()[0]

    now, done = packed(pieces, int(counts.sum()), 0), []
    fixed, open_bins, idle = 0, bins(now), 0
    for k in range(1, rounds + 1):
        if fixed + open_bins <= least or idle == PATIENCE:
            break
        loose = (F.col("room") > 0) & ((F.col("gap") > 0) | F.col("emptiest"))
        given = materialize(now.filter(loose).select(columns), "given")
        total, before = given.count(), bins(now.filter(loose))
        again = packed(given, total, k)
        after = bins(again)
        if after >= before:
            idle += 1
            continue
        done.append(now.filter(~loose))
        fixed += open_bins - before
        now, open_bins, idle = again, after, 0
    out = now
    for x in done:
        out = out.unionByName(x)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns without the text, and piece, start, length, ids_crc32, sequence_id, offset: the packing of all documents.

    Extra columns stay, whatever their names (those of the result's columns are replaced).
    """
    made = pack(materialize(tokens(docs, path, size, end_id, id_col, text_col), "pieces"), size)
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rest = [c for c in docs.columns if c not in (id_col, text_col, *new)]
    return made.select(F.col("_id").alias(id_col), *[F.col("_rest").getField(c).alias(c) for c in rest], *new)
