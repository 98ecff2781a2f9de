"""Line deduplication with two Bloom filters, one for hashes seen once and one for hashes seen twice.

Pass 1 folds every line hash into a pair of bit arrays per task; the pairs are cut into segments, shuffled
compressed and merged (a bit set in two "once" arrays goes into "twice").  Only the merged "twice" filter is sent
out; its size follows the number of lines up to a fixed most.  Pass 2 probes it: documents without a suspected line
go straight to the result, and suspects are shuffled as 16-byte digests for the exact count and the choice of the
document that keeps the line.  Only documents with a suspect meet the lines they lose.  A full filter makes more
suspects, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize, pack, unpack

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT = 8192  # bytes of a filter that travel as one row
PROBES = 3
CHUNK = 500_000  # hashes that are folded in at once


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def document_keys(text: bytes | None, least: int) -> set[bytes]:
    """The distinct keys of a document that count."""
    return {k for x in set((text or b"").split(b"\n")) if long_enough(k := line_key(x), least)}


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    at = (hashes[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)
    return (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    byte, mask = _places(hashes, bitmap.size * 8)
    return ((bitmap[byte] & mask) != 0).all(axis=0)


def _insert(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    byte, mask = _places(hashes, bitmap.size * 8)
    np.bitwise_or.at(bitmap, byte.ravel(), mask.ravel())


class OnceTwice:
    """Two Bloom filters: hashes seen at least once, and hashes that may have been seen twice."""

    def __init__(self, bits: int) -> None:
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        own, times = np.unique(hashes, return_counts=True)
        _insert(self.twice, own[(times > 1) | _holds(self.once, own)])
        _insert(self.once, own)


_SEGMENTS = pa.schema([("seg", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _fill(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, waiting = None, []
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                waiting += map(xxhash.xxh3_64_intdigest, document_keys(text, least))
                if len(waiting) >= CHUNK:
                    pair = pair or OnceTwice(bits)
                    pair.add(np.array(waiting, np.uint64))
                    waiting = []
        if waiting:
            pair = pair or OnceTwice(bits)
            pair.add(np.array(waiting, np.uint64))
        if pair:
            pack_ = zstandard.ZstdCompressor(level=1).compress
            width = min(SEGMENT, bits // 8)
            once, twice = pair.once.reshape(-1, width), pair.twice.reshape(-1, width)
            full = np.flatnonzero(once.any(axis=1))
            for part in np.array_split(full, max(1, len(full) // 512)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack_(once[i].tobytes()) for i in part], pa.binary()), pa.array([pack_(twice[i].tobytes()) for i in part], pa.binary())], schema=_SEGMENTS)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the segments as they stream in: memory is that of the segments dealt to this task, however many tasks sent them."""
    open_ = zstandard.ZstdDecompressor().decompress
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            once, twice = (np.frombuffer(open_(x), np.uint8) for x in (once, twice))
            if seg in found:
                had = found[seg]
                had[1] |= twice | (had[0] & once)
                had[0] |= once
            else:
                found[seg] = [once.copy(), twice.copy()]
    pack_ = zstandard.ZstdCompressor(level=1).compress
    for seg, (_, twice) in found.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([pack_(twice.tobytes())], pa.binary())], names=["seg", "twice"])


def twice_filter(texts: DataFrame, bits: int, least: int) -> bytes:
    """The merged filter of keys that may stand in two documents: bits / 8 bytes at most, compressed."""
    segments = texts.mapInArrow(_fill(bits, least), "seg int, once binary, twice binary").repartition("seg").mapInArrow(_merge, "seg int, twice binary")
    out = np.zeros(bits // 8, np.uint8).reshape(-1, min(SEGMENT, bits // 8))
    for row in segments.toLocalIterator():
        out[row.seg] = np.frombuffer(zstandard.decompress(bytes(row.twice)), np.uint8)
    return zstandard.compress(out.tobytes(), 1)


def _found(bitmap: np.ndarray, texts: list[bytes | None], least: int) -> tuple[list[bytes], np.ndarray]:
    """(keys, the row of each) of a batch that the filter holds."""
    keys, rows = [], []
    for i, text in enumerate(texts):
        own = document_keys(text, least)
        keys += own
        rows += [i] * len(own)
    maybe = np.flatnonzero(_holds(bitmap, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))) if keys else np.empty(0, np.int64)
    return [keys[i] for i in maybe], np.array(rows, np.int64)[maybe]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _suspects(shared, least: int):
    """(key, doc, row): the suspects of every document; row tells documents apart that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zstandard.decompress(shared.value), np.uint8)
        for batch in batches:
            keys, rows = _found(bitmap, batch.column("_text").cast(pa.binary()).to_pylist(), least)
            if keys:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(map(digest, keys), pa.binary()), batch.column("_id").take(at), batch.column("_row").take(at)], names=["key", "doc", "row"])

    return run


def _part(shared, least: int, suspected: bool):
    """The documents with a suspect, or those without, which lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zstandard.decompress(shared.value), np.uint8)
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            has = np.zeros(len(texts), bool)
            has[_found(bitmap, texts, least)[1]] = True
            chosen = batch.filter(pa.array(has if suspected else ~has))
            if chosen.num_rows:
                yield chosen

    return run


def _rewrite(least: int):
    def kept(text: bytes | None, drop: list[bytes] | None) -> tuple[bytes, int, int]:
        lines = (text or b"").split(b"\n")
        if not drop:
            return text or b"", len(lines), 0
        gone = set(drop)
        stay = [x for x in lines if not (long_enough(k := line_key(x), least) and digest(k) in gone)]
        return b"\n".join(stay), len(lines), len(lines) - len(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept(t, d) for t, d in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_drop").to_pylist(), strict=True)]
            text = pa.array([x[0] for x in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), text, batch.column("_rest"), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["_id", "_text", "_rest", "_lines", "_dropped"])

    return run


def filter_size(docs: DataFrame, text_col: str, most: int) -> int:
    """Bits of a filter: 16 for each line of the corpus, as a power of two, ``most`` at most."""
    lines = docs.agg(F.sum(F.octet_length(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "[^\n]+", "")) + 1)).first()[0]
    return min(most, max(2**16, 1 << (16 * int(lines or 0)).bit_length()))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None, most_bits: int = 2**29) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space and A-Z lower-cased.  A key of at least ``min_chars`` code
    points that stands in at least ``min_docs`` documents (2 or more) loses all its lines but those of the largest id.
    ``filter_bits``: bits of each Bloom filter, a power of two; by default 16 for each line, up to ``most_bits`` (64 MiB,
    full at some 100 million distinct lines; beyond that more and more lines become suspects and are shuffled).

    A null text is one empty line and comes out empty.  Each row is a document: rows that repeat an id count
    separately, and all rows of the largest id keep the line.  A null id is smaller than any other.  An empty table
    gives an empty table.  Other columns pass through, whatever their names (n_lines and n_dropped are replaced).
    """
    own = pack(docs, id_col, text_col)
    bits = filter_bits or filter_size(docs, text_col, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(own.select("_text"), bits, min_chars))
    kind = dict(own.dtypes)
    row = F.xxhash64("_id", "_text")  # rows with one id and one text lose the same lines, so they may share this
    schema = f"_id {kind['_id']}, _text string, _rest {kind['_rest']}"
    suspects = materialize(own.select("_id", "_text", row.alias("_row")).mapInArrow(_suspects(shared, min_chars), f"key binary, doc {kind['_id']}, row bigint"), "suspects")
    repeats = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keep")).filter(F.col("n") >= min_docs)
    repeats = materialize(repeats, "repeats")  # a table of its own, so that the join below can split a hot key
    drops = suspects.join(repeats, "key").filter(~F.col("doc").eqNullSafe(F.col("keep"))).groupBy("doc", "row").agg(F.collect_set("key").alias("_drop"))
    clean = own.mapInArrow(_part(shared, min_chars, False), schema).withColumn("_drop", F.lit(None).cast("array<binary>"))
    marked = own.mapInArrow(_part(shared, min_chars, True), schema).withColumn("_row", row)
    joined = marked.join(drops.hint("shuffle_hash"), marked["_id"].eqNullSafe(drops["doc"]) & (marked["_row"] == drops["row"]), "left").select("_id", "_text", "_rest", "_drop")
    rewritten = clean.unionByName(joined).mapInArrow(_rewrite(min_chars), f"{schema}, _lines bigint, _dropped bigint")
    base = docs.drop("n_lines", "n_dropped")
    return unpack(rewritten, base, id_col, text_col, F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
