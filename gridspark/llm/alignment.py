"""Alignment of two tokenizers' tokens over the same bytes, as a monoid of fragments.

A stretch of a text's bytes is a Fragment: the tokens before its first cut (a byte where a token of both vocabularies
ends) are an open prefix, those after its last cut an open suffix, and what is between falls into closed groups.  Two
neighbouring fragments make one: suffix and prefix between them are a stretch of their own, which closes at the border of
its tokens or stays open.  This is associative, so very long documents are cut into byte ranges whose fragments are made
by many tasks and composed as a tree; a word between spaces is a fragment that is closed at both ends, and is looked up.

Counts of linked pairs are documents of the whole corpus that hold a pair; a document's pairs meet the counts by buckets
of the first vocabulary's ids, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize
from gridspark.llm.segments import Memo, Ragged, flat, gather, split, sums

WIDE = 1 << 15  # ids of the second vocabulary fit below it, those of the first below twice that: a pair is one 31-bit number
CHUNK = 1 << 16  # bytes of a byte range of a long document
LEAVES = 8  # fragments composed together in a round
PAIRS = 1_000_000  # pairs in a bucket
SLICE = 500  # documents aligned at once
BLOCK = 200_000  # pairs, of one document each, that are counted together before they are shuffled
BLOCKS = 4  # whole blocks' worth of pairs that meet a bucket together


class Vocabularies:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import json

        from sentencepiece import SentencePieceProcessor

        from gridspark.llm.packing import Vocabulary

        self.a, self.b = Vocabulary(a_path, plain=True), SentencePieceProcessor(model_file=b_path)
        # the printable stand-ins of bytes: printable Latin-1 signs stand for themselves, the others for signs from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(own)))}
        with open(a_path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.a_bytes[i] = bytes(sign[x] for x in piece) if all(x in sign for x in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 2 * WIDE or len(self.b_bytes) > WIDE:
            raise ValueError("vocabularies above 65,536 and 32,768 ids don't fit a pair's number")
        self.a_raw, self.b_raw = Raw(self.a_bytes), Raw(self.b_bytes)
        self.a_size, self.b_size = self.a_raw.size, self.b_raw.size
        self.alone = self.b.encode("a ")[-1:]  # a last space, which the tokenizer would not see by itself

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments that begin with a space; the tokenizer adds that space itself."""
        return [x if s != " " else self.alone for s, x in zip(segments, self.b.encode([s[1:] for s in segments], num_threads=1), strict=True)]


def _ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which a token of either ends, bytes at which tokens of both end), ascending."""
    if not len(a_ends) or not len(b_ends):
        return (b_ends if len(b_ends) else a_ends), a_ends[:0]
    low, high = min(a_ends[0], b_ends[0]), max(a_ends[-1], b_ends[-1])
    mark = np.zeros(high - low + 1, np.int8)
    mark[a_ends - low] = 1
    mark[b_ends - low] += 2
    return np.flatnonzero(mark) + low, np.flatnonzero(mark == 3) + low


def cut(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of groups in a, ends of groups in b, linked a, linked b, bytes where links end) of tokens that begin and end together.

    Between two neighbouring ends of either kind lies one token of each, so there are as many links as ends; a link is
    where two tokens' ranges overlap, and no two tokens overlap in two such places.
    """
    ends, common = _ends(a_ends, b_ends)
    return np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right"), a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)], ends


class Decimals:
    """The numbers below n as text, each with a comma after it, in one array."""

    def __init__(self, n: int) -> None:
        texts = [b"%d," % i for i in range(n)]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start, self.signs = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(texts), np.uint8)


_decimals: list[Decimals] = []


def group_texts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(groups "a1,a2|b1;" of tokens cut after these numbers of tokens, one after the other; where each ends)."""
    if not _decimals:
        _decimals.append(Decimals(2 * WIDE))
    d, n_a, n_b = _decimals[0], np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    # a token's place among all, when the second vocabulary's tokens follow the first's in each group
    ids = np.empty(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + np.repeat(b_cuts - n_b, n_a)] = a
    ids[np.arange(len(b)) + np.repeat(a_cuts, n_b)] = b
    out = gather(d.signs, d.start[ids], d.size[ids]).copy()
    ends = np.cumsum(d.size[ids])
    groups = ends[a_cuts + b_cuts - 1] if len(a_cuts) else np.zeros(0, np.int64)
    out[(ends[a_cuts + b_cuts - n_b - 1] if len(a_cuts) else groups) - 1] = ord("|")
    out[groups - 1] = ord(";")
    return out.tobytes(), groups


class Raw:
    """The bytes of a vocabulary's tokens, in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def give(self, ids: np.ndarray, n: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each segment, n of them, have its bytes."""
        same = sums(self.size[ids], np.concatenate([[0], np.cumsum(n)])) == size
        kept = ids[np.repeat(same, n)]
        want = np.frombuffer(b"".join([r for r, s in zip(raw, same.tolist(), strict=True) if s]), np.uint8)
        wrong = np.flatnonzero(gather(self.bytes, self.start[kept], self.size[kept]) != want)
        same[np.repeat(np.flatnonzero(same), size[same])[wrong]] = False
        return same


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * WIDE + b


def _merge(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64)


@dataclass
class Stretch:
    """Tokens of both vocabularies with the bytes at which they end; those of a byte range that end in it."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Stretch) -> Stretch:
        return Stretch(*(np.concatenate(x) for x in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def slice(self, i: int | None, j: int | None, k: int | None, m: int | None) -> Stretch:
        return Stretch(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


@dataclass
class Fragment:
    """``left`` up to the first cut, closed groups, ``right`` after the last cut; without a cut all tokens are in ``left``."""

    left: Stretch
    has_cut: bool
    groups: bytes
    n_groups: int
    n_links: int
    keys: np.ndarray
    times: np.ndarray
    right: Stretch

    def __add__(self, other: Fragment) -> Fragment:
        if not self.has_cut:
            if not other.has_cut:
                return open_fragment(self.left + other.left)
            return Fragment(self.left + other.left, True, other.groups, other.n_groups, other.n_links, other.keys, other.times, other.right)
        if not other.has_cut:
            return Fragment(self.left, True, self.groups, self.n_groups, self.n_links, self.keys, self.times, self.right + other.left)
        groups, n, links, keys, times = closed(self.right + other.left)
        found = _merge(np.concatenate([self.keys, keys, other.keys]), np.concatenate([self.times, times, other.times]))
        return Fragment(self.left, True, self.groups + groups + other.groups, self.n_groups + n + other.n_groups, self.n_links + links + other.n_links, *found, other.right)


def open_fragment(tokens: Stretch) -> Fragment:
    none = np.zeros(0, np.int64)
    return Fragment(tokens, False, b"", 0, 0, none, none, Stretch(none, none, none, none))


def closed(tokens: Stretch) -> tuple[bytes, int, int, np.ndarray, np.ndarray]:
    """(group texts, groups, links, pairs, their links) of tokens that begin and end at a cut."""
    a_cuts, b_cuts, a, b, _ = cut(*tokens.parts())
    return group_texts(tokens.a, tokens.b, a_cuts, b_cuts)[0], len(a_cuts), len(a), *np.unique(_numbers(a, b), return_counts=True)


def fragment(tokens: Stretch) -> Fragment:
    """The fragment of a byte range's tokens, whose surroundings are not known: its first cut ends the prefix."""
    _, common = _ends(tokens.a_ends, tokens.b_ends)
    if not len(common):
        return open_fragment(tokens)
    (i, j), (k, m) = (np.searchsorted(x, common[[0, -1]], "right") for x in (tokens.a_ends, tokens.b_ends))
    return Fragment(tokens.slice(None, i, None, k), True, *closed(tokens.slice(i, j, k, m)), tokens.slice(j, None, m, None))


def whole(x: Fragment) -> tuple[bytes, int, int, np.ndarray, np.ndarray]:
    """What ``closed`` says of a document, from the fragment of all its bytes: it begins and ends at a cut."""
    first = closed(x.left)
    if not x.has_cut:
        return first
    found = _merge(np.concatenate([first[3], x.keys]), np.concatenate([first[4], x.times]))
    return first[0] + x.groups, first[1] + x.n_groups, first[2] + x.n_links, *found


class _Words:
    """Closed fragments of distinct segments: tokens, groups and links."""

    def __init__(self, v: Vocabularies) -> None:
        self.v = v
        self.a, self.b, self.links, self.groups, self.bad, self.texts = Ragged(np.int32), Ragged(np.int32), Ragged(np.int32), Ragged(np.int8), Ragged(np.int8), []

    def add(self, segments: list[str]) -> None:
        v, raw = self.v, [s.encode() for s in segments]
        size = np.array([len(r) for r in raw], np.int64)
        tokens = [v.a.encode(segments), flat(v.encode_b(segments))]
        bad = np.zeros(len(segments), bool)
        for (ids, n), own in zip(tokens, (v.a_raw, v.b_raw), strict=True):
            bad |= ~own.give(ids, n, raw, size)
        (a, n_a), (b, n_b) = ((ids[np.repeat(~bad, n)], np.where(bad, 0, n)) for ids, n in tokens) if bad.any() else tokens
        a_cuts, b_cuts, la, lb, ends = cut(a, np.cumsum(v.a_size[a]), b, np.cumsum(v.b_size[b]))
        # segments end at cuts, so groups and links fall to them in order
        n_groups = np.diff(np.searchsorted(a_cuts, np.cumsum(n_a), "right"), prepend=0)
        n_links = np.diff(np.searchsorted(ends, np.cumsum(np.where(bad, 0, size)), "right"), prepend=0)
        text, text_ends = group_texts(a, b, a_cuts, b_cuts)
        at = np.concatenate([[0], text_ends])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        self.texts += [text[i:j] for i, j in zip(at, at[1:], strict=False)]
        for table, values, lengths in ((self.a, a, n_a), (self.b, b, n_b), (self.links, _numbers(la, lb), n_links), (self.bad, bad, np.ones(len(segments), np.int64))):
            table.add(values, lengths)
        self.groups.add(np.zeros(int(n_groups.sum()), np.int8), n_groups)


_ready: dict[tuple[str, str], Memo] = {}


def _memo(a_path: str, b_path: str) -> Memo:
    if (a_path, b_path) not in _ready:
        v = Vocabularies(a_path, b_path)
        _ready[a_path, b_path] = Memo(lambda: _Words(v), 100_000, 3_000_000)
    return _ready[a_path, b_path]


#: Doc rows have an _id and the numbers; block rows a batch's (docs, keys, times), its documents' rows being block + docs;
#: chunk rows a byte range's tokens, those of the first vocabulary as docs and of the second as keys.
MADE = "_kind string, block long, row long, chunk int, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, docs binary, keys binary, times binary"
_FIELDS = [("_kind", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()), ("docs", pa.binary()), ("keys", pa.binary()), ("times", pa.binary())]


def _rows(rows: list[dict], more: list[tuple[str, pa.DataType, list]] = ()) -> pa.RecordBatch:
    fields = [(n, k, [r.get(n) for r in rows]) for n, k in _FIELDS] + list(more)
    return pa.RecordBatch.from_arrays([pa.array(v, k) if not isinstance(v, pa.Array) else v for _, k, v in fields], names=[n for n, _, _ in fields])


def _doc(groups: bytes, n: tuple[int, int, int, int], keep: bool) -> dict:
    """groups: each with a semicolon after it, which the last one loses."""
    return {"_kind": "doc", **dict(zip(("n_a", "n_b", "n_groups", "n_links"), n, strict=True)), "groups": groups[:-1].decode() if keep else None, "groups_sha256": hashlib.sha256(groups[:-1]).hexdigest() if n[0] else ""}


def _pairs(block: int, docs: np.ndarray, keys: np.ndarray, times: np.ndarray) -> dict:
    return {"_kind": "block", "block": block, "docs": docs.astype("<u4").tobytes(), "keys": keys.astype("<i4").tobytes(), "times": times.astype("<u4").tobytes()}


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often) of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _align(a_path: str, b_path: str, chunk: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, first = _memo(a_path, b_path), TaskContext.get().partitionId() << 40
        block, held = first, []  # a block's first row, and the pairs of its documents so far
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            texts = batch.column("_text")
            distinct, index, cuts = split(texts)
            slot = memo.slots(distinct)[index]
            words = memo.tables
            bad = sums(words.bad.values[slot], cuts) > 0
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
            long = (size > chunk) & ~bad
            n_a, n_b, n_groups = (sums(t.lengths()[slot], cuts) for t in (words.a, words.b, words.groups))
            # links of the short documents, counted by document
            short = np.repeat(~(long | bad), np.diff(cuts))
            linked, length = words.links.of(slot[short])
            owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(cuts))[short], length)
            n_links = np.bincount(owner, minlength=len(texts))
            pairs, times = _runs(np.sort(owner << 31 | linked))
            held.append(((pairs >> 31) + (first - block), pairs & (1 << 31) - 1, times))
            rows, ids = [], []
            slots, names = slot.tolist(), batch.column("_id")
            for i, (p, q) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                row = first + i
                if bad[i] or p == q:
                    rows.append({**_doc(b"", (0, 0, 0, 0), keep), "row": row})
                elif not long[i]:
                    rows.append({**_doc(b"".join([words.texts[s] for s in slots[p:q]]), (int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i])), keep), "row": row})
                else:
                    (a, _), (b, _) = words.a.of(slot[p:q]), words.b.of(slot[p:q])
                    a_ends, b_ends = np.cumsum(words.v.a_size[a]), np.cumsum(words.v.b_size[b])
                    last = (int(size[i]) - 1) // chunk
                    borders = np.arange(1, last + 2) * chunk
                    at, bt = np.searchsorted(a_ends, borders, "right"), np.searchsorted(b_ends, borders, "right")
                    for k, (s, t, u, w) in enumerate(zip([0, *at[:-1]], at, [0, *bt[:-1]], bt, strict=True)):
                        sent = _sent(Stretch(a[s:t], a_ends[s:t], b[u:w], b_ends[u:w]))
                        rows.append({"_kind": "chunk", "row": row, "chunk": k, "n_a": int(n_a[i]), "n_b": int(n_b[i]), "docs": sent[0], "keys": sent[1]})
                ids += [i] * (len(rows) - len(ids))
            first += len(texts)
            if sum(len(x[0]) for x in held) >= BLOCK:
                rows.append(_pairs(block, *map(np.concatenate, zip(*held, strict=True))))
                ids.append(None)
                block, held = first, []
            yield _rows(rows, [("_id", names.type, names.take(pa.array(ids, pa.int64())))])
            kind = names.type
        memo.clear()
        if held:
            yield _rows([_pairs(block, *map(np.concatenate, zip(*held, strict=True)))], [("_id", kind, [None])])

    return run


def _stretch(a: bytes, b: bytes) -> Stretch:
    (x, y), (z, w) = (np.split(np.frombuffer(v, "<i8"), 2) for v in (a, b))
    return Stretch(x, y, z, w)


#: a fragment as a row; tokens with their ends are one binary
FRAGMENT = "row long, chunk int, n_a long, n_b long, left_a binary, left_b binary, has_cut boolean, groups binary, n_groups long, n_links long, keys binary, times binary, right_a binary, right_b binary"


def _sent(x: Stretch) -> tuple[bytes, bytes]:
    return x.a.astype("<i8").tobytes() + x.a_ends.astype("<i8").tobytes(), x.b.astype("<i8").tobytes() + x.b_ends.astype("<i8").tobytes()


def _fragment_row(head: tuple, x: Fragment) -> dict:
    (la, lb), (ra, rb) = _sent(x.left), _sent(x.right)
    names = [f.split()[0] for f in FRAGMENT.split(", ")]
    return dict(zip(names, (*head, la, lb, x.has_cut, x.groups, x.n_groups, x.n_links, x.keys.astype("<i8").tobytes(), x.times.astype("<i8").tobytes(), ra, rb), strict=True))


def _fragment_of(r: dict) -> Fragment:
    return Fragment(_stretch(r["left_a"], r["left_b"]), r["has_cut"], r["groups"], r["n_groups"], r["n_links"], np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["times"], "<i8"), _stretch(r["right_a"], r["right_b"]))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_FRAGMENT = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in FRAGMENT.split(", "))])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            made = _fragment_row((r["row"], r["chunk"], r["n_a"], r["n_b"]), fragment(_stretch(r["docs"], r["keys"])))
            yield from pa.Table.from_pylist([made], _FRAGMENT).to_batches()


def _compose(keep: bool, last: bool):
    def run(table: pa.Table) -> pa.Table:
        """Neighbouring fragments of one document as one, which the last round closes."""
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        made, first = _fragment_of(rows[0]), rows[0]
        for r in rows[1:]:
            made = made + _fragment_of(r)
        if not last:
            return pa.Table.from_pylist([_fragment_row((first["row"], first["chunk"] // LEAVES, first["n_a"], first["n_b"]), made)], _FRAGMENT)
        groups, n_groups, n_links, keys, times = whole(made)
        doc = _doc(groups, (first["n_a"], first["n_b"], n_groups, n_links), keep)
        # its pairs are a block of their own, of one document
        return pa.Table.from_batches([_rows([{**doc, "row": first["row"]}, _pairs(first["row"], np.zeros(len(keys), np.int64), keys, times)])])

    return run


def _long_documents(chunks: DataFrame, keep: bool) -> DataFrame:
    """Rows like the short documents', by composing fragments as a tree, LEAVES of them in a task."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = chunks.select("row", "chunk", "n_a", "n_b", "docs", "keys").repartition(parts, "row", "chunk").mapInArrow(_leaves, FRAGMENT)
    most = chunks.agg(F.max("chunk")).first()[0] or 0
    while True:
        most //= LEAVES
        now = now.groupBy("row", F.floor(F.col("chunk") / LEAVES).alias("_part")).applyInArrow(_compose(keep, most == 0), MADE if most == 0 else FRAGMENT)
        if most == 0:
            return now


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys in batch.column("keys").to_pylist():
            pair, n = _runs(np.sort(np.frombuffer(keys, "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def _bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    """By the first vocabulary's id, so that a bucket has all its pairs; ids are mixed, as frequent ones are neighbours."""
    return (pair.astype(np.int64) // WIDE * 2654435761 >> 7) % buckets


def _with_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _bucket(batch.column("pair").to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), batch.column("n"), pa.array(found)], names=["pair", "n", "bucket"])

    return run


def _shelve(table: pa.Table) -> pa.Table:
    """A bucket's pairs in order, their counts, and whether a count is its first id's highest."""
    pair, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    _, size = _runs(pair // WIDE)
    best = np.repeat(np.maximum.reduceat(n, np.cumsum(size) - size), size) == n
    row = {"bucket": [table.column("bucket")[0].as_py()], "pairs": [pair.astype("<i4").tobytes()], "counts": [n.astype("<i8").tobytes()], "best": [best.tobytes()]}
    return pa.table(row, pa.schema([("bucket", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())]))


def _deal(buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, keys, times in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "keys", "times")), strict=True):
                docs, keys, times = np.frombuffer(docs, "<u4"), np.frombuffer(keys, "<i4"), np.frombuffer(times, "<u4")
                where = _bucket(keys, buckets)
                order = np.argsort(where, kind="stable")
                found, size = _runs(where[order])
                parts = [np.split(x[order], np.cumsum(size)[:-1]) for x in (docs, keys, times)] if len(found) else [[], [], []]
                group = (block * 2654435761 >> 11) % groups
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([group] * len(found), pa.int64()), pa.array([block] * len(found), pa.int64()), *[pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]], names=["bucket", "part", "block", "docs", "keys", "times"])

    return run


def _look_up(blocks: pa.Table, shelf: pa.Table) -> pa.Table:
    pairs, counts, best = (np.frombuffer(shelf.column(c)[0].as_py(), k) for c, k in (("pairs", "<i4"), ("counts", "<i8"), ("best", bool))) if len(shelf) else (np.zeros(0, np.int64),) * 3
    rows, n_best, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block, docs, keys, times in zip(*(blocks.column(c).to_pylist() for c in ("block", "docs", "keys", "times")), strict=True):
        docs, keys, times = np.frombuffer(docs, "<u4").astype(np.int64), np.frombuffer(keys, "<i4"), np.frombuffer(times, "<u4").astype(np.int64)
        at = np.searchsorted(pairs, keys)
        own, size = _runs(docs)
        first = np.cumsum(size) - size
        n_best.append(np.add.reduceat(np.where(best[at], times, 0), first))
        total.append(np.add.reduceat(counts[at] * times, first))
        rows.append(own + block)
    return pa.table({"row": np.concatenate(rows), "n_best": np.concatenate(n_best), "count_sum": np.concatenate(total)})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, keep_groups: bool = False, pairs_per_bucket: int = PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]): a row for each row of docs.

    a_path: a byte-level vocabulary, whose text is a space and the text; b_path: a piece vocabulary, which adds that space
    itself.  Null and empty texts, and those whose tokens don't give their bytes back, have no tokens: zeros and ''.
    Rows are documents of their own, whatever their ids; repeats count as often as they stand there, equal counts are all
    highest.  Documents above ``chunk`` bytes are cut into byte ranges.  Other columns are not carried.  An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").alias("_text"))
    own = own.withColumn("_text", F.coalesce("_text", F.lit("")))
    kind = dict(own.dtypes)["_id"]
    made = materialize(own.mapInArrow(_align(a_path, b_path, chunk, keep_groups), f"{MADE}, _id {kind}"), "aligned")
    long = materialize(_long_documents(made.filter("_kind = 'chunk'"), keep_groups), "long")
    blocks = made.filter("_kind = 'block'").select("block", "docs", "keys", "times").unionByName(long.filter("_kind = 'block'").select("block", "docs", "keys", "times"))
    counts = materialize(blocks.select("keys").mapInArrow(_count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    buckets = max(1, -(-counts.count() // pairs_per_bucket))
    groups = max(1, -(-blocks.count() // (BLOCKS * buckets)))
    shelves = counts.mapInArrow(_with_bucket(buckets), "pair int, n long, bucket long").groupBy("bucket").applyInArrow(_shelve, "bucket long, pairs binary, counts binary, best binary")
    shelves = shelves.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    dealt = blocks.mapInArrow(_deal(buckets, groups), "bucket long, part long, block long, docs binary, keys binary, times binary")
    found = dealt.groupBy("bucket", "part").cogroup(shelves.groupBy("bucket", "part")).applyInArrow(_look_up, "row long, n_best long, count_sum long")
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups]
    first = made.filter("_kind = 'doc'").select("_id", *columns)
    named = made.filter("_kind = 'chunk' and chunk = 0").select("_id", "row")
    far = long.filter("_kind = 'doc'").select(*columns).join(named, "row").select("_id", *columns)
    out = first.unionByName(far).join(found, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * keep_groups)
