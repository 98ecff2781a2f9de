"""Near-duplicates of a stated Jaccard similarity by wide SimHash.

Candidates come by the general pigeonhole principle: correlated bits are put into the same part, the collisions of
every part are counted over all fingerprints, and a dynamic programme gives each part its threshold t (-1: left out),
so that fingerprints that differ in fewer than the sum of t + 1 bits agree up to t bits on some part.  At a similarity
of 0.8 two fingerprints differ in 15 % of their bits, at times in a quarter, and no thresholds that add up to so large
a distance leave a part selective.  So the fingerprint is made wide, with more parts than are needed, and the programme
asks for the thresholds with the least estimated signatures and candidates among all that find a pair at the similarity
itself with the probability ``recall``; pairs that are more alike are found nearly always, and those within the sum always.
Candidates must agree in a 64-bit fingerprint of its own to within FAR bits and in length, those of crowded signatures
also in the whole fingerprint, and are then verified exactly on their whole sets of shingles; those that are left of
crowded signatures are verified where they meet, so that they make no rows unless they are alike.

Equal sets are one node.  A signature that unusually many nodes share is not joined with itself: its holders meet a few
of their own first, drawn by hash; what is in one component after that is not compared again, and all other pairs are.
Two holders of such signatures are not compared under their other signatures either until then, so that a group of near
copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, inf, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize
from gridspark.llm.components import connected_components

EPS = 1e-9
FAR = 18  # of 64 bits; at a similarity of 0.8 the mean is 9.7 and the standard deviation 2.9
CANDIDATE = 1 / 40  # cost of comparing two fingerprints, in signatures
SPARE = 1.2  # parts to choose from, times those needed
STRETCH = 8  # lanes of 64 bits whose bits are correlated with each other
GRAIN = 2000  # steps in which the programme adds up what parts find


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, none if it has no words."""
    words = (text or b"").lower().split()
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts[: len(words) - n + 1], stops[n - 1 :], strict=True)], np.uint64))


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def bits_agree(alike: float) -> float:
    """The chance that a bit of SimHash agrees for two sets of this Jaccard similarity and one size."""
    return 1 - acos(2 * alike / (1 + alike)) / pi


def layout(n: int, alike: float, recall: float) -> tuple[int, int]:
    """(width, parts) with the least estimated cost for n fingerprints."""
    agree = bits_agree(alike)
    return min((parts * n * (1 + CANDIDATE * n / 2 / 2**w), w, parts) for w in range(6, 40) for parts in [ceil(log(1 - recall) / log1p(-(agree**w)))])[1:]


def lanes_for(width: int, parts: int) -> int:
    """Lanes that hold SPARE times so many parts, none across two stretches."""
    lanes = 1
    while sum(64 * len(s) // width for s in _stretches(lanes)) < SPARE * parts:
        lanes += 1
    return lanes


def _stretches(lanes: int) -> list[range]:
    return [range(a, min(a + STRETCH, lanes)) for a in range(0, lanes, STRETCH)]


def group_bits(both: np.ndarray, n: int, width: int) -> list[list[int]]:
    """As many parts of a width as fit, each grown from a bit by the bits that correlate most with it.

    both: how many of n fingerprints set both bits.
    """
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(rho, 0)
    left, out = np.ones(len(p), bool), []
    for _ in range(len(p) // width):
        near, part = rho[:, left].sum(axis=1), []
        for _ in range(width):
            best = int(np.argmax(np.where(left, near, -1.0)))
            near = near + rho[best] if part else rho[best]
            part.append(best)
            left[best] = False
        out.append(sorted(part))
    return out


def allocate(width: int, same: list[float], agree: list[float], n: int, alike: float, recall: float) -> list[int]:
    """Every part's threshold (-1: left out): the least estimated signatures and candidates that reach the recall.

    same: pairs of n fingerprints that agree on the whole part; agree: the chance that two bits of the part agree.
    """
    bit, unit = bits_agree(alike), -log(1 - recall) / GRAIN
    best, chosen = np.full(GRAIN + 1, inf), []
    best[0] = 0.0
    for pairs, a in zip(same, agree, strict=True):
        new, of = best.copy(), np.full((GRAIN + 1, 2), -1)
        of[:, 0] = np.arange(GRAIN + 1)
        for t in (0, 1):
            finds = sum(comb(width, k) * bit ** (width - k) * (1 - bit) ** k for k in range(t + 1))
            gain = int(-log1p(-finds) / unit)
            probes = comb(width, t)
            joined = probes * pairs + (n * n / 2 * width * a ** (width - 1) * (1 - a) if t else 0.0)
            cost = n * probes + CANDIDATE * joined
            for g in np.flatnonzero(best < inf).tolist():
                to = min(GRAIN, g + gain)
                if best[g] + cost < new[to]:
                    new[to], of[to] = best[g] + cost, (g, t)
        best = new
        chosen.append(of)
    if best[GRAIN] == inf:
        raise ValueError("too few parts for this recall")
    at, out = GRAIN, []
    for of in reversed(chosen):
        at, t = of[at].tolist()
        out.append(t)
    return out[::-1]


Probes = list[tuple[int, list[int]]]


def probes_of(parts: list[list[int]], thresholds: list[int]) -> Probes:
    """(number, bits) of every signature: two fingerprints share one exactly if some part agrees within its threshold."""
    out: Probes = []
    for i, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t == 0:
            out.append((64 * i, part))
        if t == 1:
            out += [(64 * i + 1 + k, part[:k] + part[k + 1 :]) for k in range(len(part))]
    return out


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """64 * lanes bits (0 or 1): a bit is 1 if it is set in over half of the hashes, rehashed for each lane."""
    ones = np.zeros(64 * lanes, np.int64)
    turns = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), 255):  # 255: counts of a part fit a byte
        x = hashes[i : i + 255, None] + turns
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


_SETS = "doc_id bigint, digest binary, node bigint, n int, sketch bigint, wide array<bigint>, body binary"


def _sets(size: int, lanes: int):
    """The set of every row as 32-bit hashes, its wide fingerprint and the 64-bit one, which is a lane more of the wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingles(text, size)
                wide = np.packbits(wide_fingerprint(hashes, lanes + 1), bitorder="little").view("<i8").tolist()
                out.append((xxhash.xxh3_64_intdigest(hashes.tobytes()), len(hashes), wide[-1], wide, np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()))
            node, n, sketch, wide, body = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(sketch, pa.int64()), pa.array(wide, pa.list_(pa.int64())), pa.array(body, pa.binary())], names=["doc_id", "digest", "node", "n", "sketch", "wide", "body"])

    return run


def _bits(wide: pa.Array) -> np.ndarray:
    """A row of bits (0 or 1) for each fingerprint."""
    own = np.ascontiguousarray(wide.flatten().to_numpy(zero_copy_only=False), "<i8").view(np.uint8)
    return np.unpackbits(own.reshape(len(wide), len(own) // max(1, len(wide))), axis=1, bitorder="little")


def _pair_counts(lanes: int):
    """(bit, counts): how many fingerprints of a task set this bit and each of its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.zeros((64 * len(s), 64 * len(s)), np.int64) for s in _stretches(lanes)]
        for batch in batches:
            bits = _bits(batch.column(0)).astype(np.float32)
            for s, sums in zip(_stretches(lanes), both, strict=True):
                x = bits[:, 64 * s.start : 64 * s.stop]
                sums += (x.T @ x).astype(np.int64)
        rows = [row.tobytes() for sums in both for row in sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["bit", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for bit, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[bit] = sums.get(bit, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["bit", "counts"])


def bit_counts(nodes: DataFrame, lanes: int) -> list[np.ndarray]:
    """For each stretch, how many nodes set both of two bits; summed on the executors over all nodes with words.

    A task's sums are a row of at most 4 KiB for each bit, so few tasks make them.
    """
    kind = "bit int, counts binary"
    counted = nodes.filter("n > 0").select("wide").coalesce(32).mapInArrow(_pair_counts(lanes), kind)
    out = [np.zeros((64 * len(s), 64 * len(s)), np.int64) for s in _stretches(lanes)]
    for bit, counts in counted.repartitionById(16, F.col("bit") % 16).mapInArrow(_summed, kind).collect():
        out[bit // (64 * STRETCH)][bit % (64 * STRETCH)] = np.frombuffer(counts, np.int64)
    return out


def _explode(probes: Probes):
    """A row for each signature of the fingerprints in the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = None
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            bits = _bits(batch.column(0))
            if powers is None or len(powers) != bits.shape[1]:
                powers = np.zeros((bits.shape[1], len(probes)))
                for k, (_, at) in enumerate(probes):
                    powers[at, k] = 2.0 ** np.arange(len(at))
            sig = (bits.astype(float) @ powers).astype(np.int64) | (np.array([p for p, _ in probes], np.int64) << 40)
            of = pa.array(np.repeat(np.arange(len(bits)), len(probes)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sig.ravel()), *(c.take(of) for c in batch.columns[1:])], names=["sig", *batch.schema.names[1:]])

    return run


def _by_signature(nodes: DataFrame, probes: Probes, *names: str) -> DataFrame:
    """(sig, names): nodes with these columns, a row for each signature."""
    own = nodes.filter("n > 0").select(F.col("wide").alias("bits"), *names)
    return own.mapInArrow(_explode(probes), ", ".join(["sig bigint", *(f"{c} {kind}" for c, kind in own.dtypes[1:])]))


def pigeonholes(nodes: DataFrame, width: int, lanes: int, alike: float, recall: float) -> tuple[list[list[int]], list[int], DataFrame]:
    """(parts, thresholds, counts): parts of correlated bits, their thresholds, and how many nodes share a whole part.

    counts: (sig, c) where c > 1, of all parts, those left out as well.
    """
    n = nodes.filter("n > 0").count()
    both = bit_counts(nodes, lanes)
    parts = [[64 * STRETCH * k + b for b in part] for k, x in enumerate(both) for part in group_bits(x, n, width)]
    p = np.concatenate([x.diagonal() for x in both]) / max(n, 1)
    agree = [float(np.mean(p[part] ** 2 + (1 - p[part]) ** 2)) for part in parts]
    counts = materialize(_by_signature(nodes, probes_of(parts, [0] * len(parts))).groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1"), "collisions")
    same = {r.part: float(r.pairs) for r in counts.groupBy(F.shiftright("sig", 46).alias("part")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    return parts, allocate(width, [same.get(i, 0.0) for i in range(len(parts))], agree, n, alike, recall), counts


def _verify(alike: float):
    """Pairs (u, v, bodies a and b) of a similarity of at least ``alike``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= alike * (len(a) + len(b) - same) - EPS)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, body) with the hashes of a set as a list."""
    for batch in batches:
        lists = [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["node", "body"])


def _alike(a: Column, b: Column, alike: float) -> Column:
    """Whether two lists of distinct hashes have a similarity of at least ``alike``, as _verify has it."""
    return F.size(F.array_intersect(a, b)) * (1 + alike) >= (F.size(a) + F.size(b)) * alike - EPS


def _near(n: Column, m: Column, sketch: Column, other: Column, alike: float) -> Column:
    """Whether two sets of n and m shingles with these sketches may be alike."""
    return (F.bit_count(sketch.bitwiseXOR(other)) <= FAR) & (F.least(n, m) >= F.greatest(n, m) * alike - EPS)


def _nearer(a: Column, b: Column, alike: float, lanes: int) -> Column:
    """Whether two whole fingerprints differ in no more bits than five standard deviations above the mean at ``alike``."""
    n, p = 64 * lanes, 1 - bits_agree(alike)
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return apart <= int(n * p + 5 * sqrt(n * p * (1 - p)))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8, recall: float = 0.99, rounds: int = 2, crowded: int | None = None) -> DataFrame:
    """(component, doc_id, digest): one row per component, naming its row with the smallest id (nulls last), then digest.

    Rows are alike if the Jaccard similarity of their sets of shingles is at least ``alike``; a component is all that
    such pairs reach.  A row is told apart by its id and the MD5 of its text, so rows with a null id and rows that
    repeat an id are rows of their own.  Texts without words are alike.  An empty table gives an empty table.
    The holders of a signature of more than ``crowded`` nodes, by default thrice what chance deals to one and 64 at least,
    meet ``rounds`` times two of its holders and are then compared across components.
    """
    rows = docs.count()
    width, needed = layout(max(rows, 1), alike, recall)
    lanes = lanes_for(width, needed)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    sets = materialize(own.mapInArrow(_sets(shingle, lanes), _SETS), "sets")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = materialize(sets.groupBy("node").agg(F.min(name).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "nodes")
    parts, thresholds, counts = pigeonholes(nodes, width, lanes, alike, recall)
    probes = probes_of(parts, thresholds)
    crowded = crowded or max(64, 3 * rows // 2**width)
    # a part's own signatures are counted already, those with a bit blanked out are not
    whole, blanked = [64 * i for i, t in enumerate(thresholds) if t == 0], [p for p in probes if p[0] % 64]
    counts = counts.filter(F.shiftright("sig", 40).isin(whole))
    if blanked:
        counts = counts.unionByName(_by_signature(nodes, blanked).groupBy("sig").agg(F.count("*").alias("c")))
    crowds = materialize(counts.filter(F.col("c") > crowded).select("sig"), "crowds")
    crowd = materialize(_by_signature(nodes, probes, "node", "n", "sketch").join(crowds, "sig", "left_semi"), "crowd")
    dense = materialize(crowd.select("node").distinct().withColumn("dense", F.lit(True)), "dense")
    marked = nodes.join(dense, "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    quiet = materialize(_by_signature(marked, probes, "node", "n", "sketch", "dense").join(crowds, "sig", "left_anti"), "signatures")
    ends = (F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    near = _near(F.col("a.n"), F.col("b.n"), F.col("a.sketch"), F.col("b.sketch"), alike)

    def meet(x: DataFrame, y: DataFrame, which: Column) -> DataFrame:
        return x.alias("a").join(y.alias("b"), (F.col("a.sig") == F.col("b.sig")) & which & near).select(*ends)

    met = meet(quiet, quiet, (F.col("a.node") < F.col("b.node")) & ~(F.col("a.dense") & F.col("b.dense")))
    is_crowded = crowd.limit(1).count() > 0
    if is_crowded and rounds:
        hub = [F.struct(F.xxhash64(F.lit(turn), "node").alias("drawn"), "node", "n", "sketch") for turn in range(rounds)]
        hubs = materialize(crowd.groupBy("sig").agg(F.array(*[pick(h) for h in hub for pick in (F.min, F.max)]).alias("hubs")), "hubs")
        alike_hubs = F.filter("hubs", lambda h: (h["node"] != F.col("node")) & _near(F.col("n"), h["n"], F.col("sketch"), h["sketch"], alike))
        drawn = crowd.join(hubs, "sig").select("node", F.explode(alike_hubs.getField("node")).alias("hub"))
        met = met.unionByName(drawn.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")))
    pairs = materialize(met.distinct(), "pairs")
    # the sets of all nodes that are compared, each from the row that names it
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowd.select("node")).distinct()
    firsts = nodes.join(asked, "node").select(F.col("node").alias("_node"), F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    found = sets.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("node") == F.col("_node")))
    bodies = materialize(found.select("node", "body").dropDuplicates(["node"]), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda node, body: bodies.select(F.col("node").alias(node), F.col("body").alias(body))
        both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")
        return materialize(both.mapInArrow(_verify(alike), "u bigint, v bigint"), "links")

    def joined(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """(node, root) of all that is linked so far: what was joined before goes in as one edge a node."""
        before = links if roots is None else links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return materialize(connected_components(before), "roots")

    roots = joined(verified(pairs))
    if is_crowded:
        # what is left, under all signatures of crowded ones' holders: only those outside a signature's largest component
        # are marked, and meet all its holders of other components
        whole_sets = bodies.join(dense.select("node"), "node").select("node", "body").mapInArrow(_hash_lists, "node bigint, body array<int>")
        left = nodes.join(whole_sets, "node").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
        left = materialize(_by_signature(left, probes, "node", "n", "sketch", "part", "wide", "body"), "left")
        held = left.groupBy("sig", "part").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.count("*").alias("parts"))
        main = materialize(held.filter("parts > 1").select("sig", "main"), "main")  # a table of its own, so that the join can split a hot signature
        others = materialize(left.join(main, "sig").filter("part <> main"), "others")
        once = (F.col("a.part") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
        apart = (F.col("a.part") != F.col("b.part")) & once & near & _nearer(F.col("a.wide"), F.col("b.wide"), alike, lanes + 1) & _alike(F.col("a.body"), F.col("b.body"), alike)
        met = meet(left, others, apart)
        roots = joined(materialize(met.distinct(), "links"), roots)
    named = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("first").alias("first"))
    return named.select("component", "first.doc_id", "first.digest")
