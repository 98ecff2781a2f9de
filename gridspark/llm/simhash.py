"""Near-duplicates by SimHash, searched with the general pigeonhole principle.

Fingerprints within distance T agree up to t_i bits on some part i whenever the parts' thresholds add up to
T - parts + 1 (a threshold of -1 leaves a part out).  Correlated bits are put into the same part, the collisions of
every part are counted over all fingerprints, and a dynamic programme spreads the thresholds so that the estimated
candidates are fewest.  Each fingerprint probes with its part's bits (t bits blanked out in turn); pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize
from gridspark.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[a:b], 42) for a, b in zip(starts[: len(words) - n + 1], stops[n - 1 :], strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per row of docs."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(both.ravel())], names=["cell", "n"])


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints set both bits; summed on the executors."""
    out = np.zeros(BITS * BITS)
    for cell, n in fps.select("fp").mapInArrow(_pair_counts, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal width, each grown from a bit by the bits that correlate most with it."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        part = [max(left, key=lambda b: (rho[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (rho[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def _mask(part: list[int]) -> int:
    m = sum(1 << b for b in part)
    return m - (1 << 64) if m >= 1 << 63 else m


def collisions(fps: DataFrame, layouts: list[list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints that agree on a whole part, for every part of every layout, counted over all of them."""
    keys = F.array(*[F.struct(F.lit(i).alias("layout"), F.lit(j).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("long")).alias("bits")) for i, parts in enumerate(layouts) for j, p in enumerate(parts)])
    counts = fps.select(F.explode(keys).alias("k")).groupBy("k.layout", "k.part", "k.bits").count()
    return {(r.layout, r.part): float(r.pairs) for r in counts.groupBy("layout", "part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}


def allocate(parts: list[list[int]], same: list[float], both: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: part not probed) that sum to distance - parts + 1 with the least estimated candidates and probes."""
    p = both.diagonal() / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        odds = [(1 - agree[b]) / max(agree[b], 1e-9) for b in parts[i]]
        ways = np.ones(1)
        for o in odds:
            ways = np.convolve(ways, [1, o])
        probes = len(list(combinations(range(len(parts[i])), t))) if t else 1
        return n * probes + (same[i] + n * n / 2 * float(np.prod(agree[parts[i]]))) * float(ways[: t + 1].sum()) * probes ** 0.5

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(parts)):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                cand = (c + cost(i, t), [*ts, t])
                if total + t not in step or cand[0] < step[total + t][0]:
                    step[total + t] = cand
        best = step
    return best[distance - len(parts) + 1]


def probes(fp: Column, parts: list[list[int]], thresholds: list[int]) -> Column:
    """Array of the signatures of a fingerprint: two of them share one exactly if some part agrees within its threshold."""
    out = []
    for i, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        for gone in combinations(part, t) if t >= 0 else ():
            stay = [b for b in part if b not in gone]
            out.append(F.struct(F.lit(i * 4096 + sum((part.index(b) + 1) * 64**k for k, b in enumerate(gone))).alias("probe"), fp.bitwiseAND(F.lit(_mask(stay)).cast("long")).alias("bits")))
    return F.array(*out)


def links(fps: DataFrame, distance: int = 2, layouts: tuple[int, ...] = (2, 3, 4), crowded: int = 64) -> DataFrame:
    """(u, v): fingerprints' smallest ids, linked so that the components are those of all pairs within distance.

    fps: (fp, rep), distinct.  A signature shared by more than ``crowded`` fingerprints is not joined with itself:
    its members meet instead at the values one bit away from them, where at most 65 can meet.  That way is exact for
    distance 2, so no other distance is taken (simhash_similar finds pairs that are further apart).
    """
    if distance != 2:
        raise ValueError("links are searched at distance 2")
    n = fps.count()
    both = bit_counts(fps)
    ways = [group_bits(both, n, k) for k in layouts]
    same = collisions(fps, ways)
    _, parts, thresholds = min((cost, parts, ts) for i, parts in enumerate(ways) for cost, ts in [allocate(parts, [same.get((i, j), 0.0) for j in range(len(parts))], both, n, distance)])
    sigs = materialize(fps.select("fp", "rep", F.explode(probes(F.col("fp"), parts, thresholds)).alias("s")).select("s.probe", "s.bits", "fp", "rep"), "probes")
    sizes = sigs.groupBy("probe", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    quiet = sigs.join(sizes.filter(F.col("n") <= crowded).drop("n"), ["probe", "bits"])
    a, b = quiet.alias("a"), quiet.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = a.join(b, (F.col("a.probe") == F.col("b.probe")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    loud = sigs.join(sizes.filter(F.col("n") > crowded).drop("n"), ["probe", "bits"]).select("fp", "rep").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b])).cast("long")) for b in range(BITS)])
    meet = loud.select("rep", F.explode(around).alias("z"))
    first = meet.groupBy("z").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).filter("v < last").drop("last")
    pairs = pairs.unionByName(meet.join(first, "z").select(F.col("rep").alias("u"), "v"))
    return pairs.filter("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest id that links reach.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.  Equal
    fingerprints collapse to one row before anything is joined, so copies cost nothing.  A null id never names a
    component; a component of null ids alone has a null component_id.  An empty table gives an empty table.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(links(fps.filter("rep is not null"), distance))
    named = fps.join(roots, fps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
