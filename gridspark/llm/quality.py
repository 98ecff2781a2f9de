"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the text alone.  Shallow trees are boosted in cycles, one feature at a time, on its bins; their sums
are one lookup table per feature.  The pairs that explain most of what is left get tables of their own, boosted the
same way.  A score is the sum of the tables' entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeats", "upper", "digits", "marks", "bars", "enders", "non_ascii", "short_words", "line_length", "same_lines", "sd_word", "capital_words", "marked_words")
_UPPER, _DIGIT, _MARK, _END = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_END[[33, 44, 46, 58, 59, 63]] = 1


def features(text: bytes | None) -> list[float]:
    """NAMES for one text; finite for null, empty and very long texts."""
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen = Counter(words)
    marks = int(hist @ _MARK)
    enders = int(hist @ _END)
    filled = [x for x in lines if x.strip()]
    capital = sum(w[:1].isupper() for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        float(np.log1p(len(words))), float(length.mean()), float((length > 14).mean()), len(seen) / n, max(seen.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, int(hist @ _UPPER) / size, int(hist @ _DIGIT) / size, (marks - enders) / size, int(hist[124]) / size, enders / size,
        int(hist[128:].sum()) / size, float((length < 4).mean()), float(np.log1p(size / max(1, len(filled)))), 1 - len(set(filled)) / max(1, len(filled)),
        float(length.std()), capital / n, marked / n,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray]
    start: float
    mains: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]
        z = self.start + sum(t[b] for t, b in zip(self.mains, bins, strict=True))
        for (i, j), t in zip(self.pairs, self.tables, strict=True):
            z = z + t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: float, h: float, ridge: float) -> tuple[float, float]:
    return g * g / (h + ridge), g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree on one feature's bins: up to ``leaves`` runs of bins, split greedily; a value for each bin."""
    runs, out = [(0, len(g))], np.zeros(len(g))
    for _ in range(leaves - 1):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(runs):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - cg[-1] ** 2 / (ch[-1] + ridge)
            at = int(np.argmax(gain))
            best = max(best, (float(gain[at]), k, a + at + 1))
        if not best[2]:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    for a, b in runs:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)[1]
    return out


def _quad(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, table) of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.arange(g.shape[0] - 1)[:, None], np.arange(g.shape[1] - 1)[None, :]
    part = lambda c: (c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b])
    gs, hs = part(cg), part(ch)
    gain = sum(x * x / (y + ridge) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, pairs: int = 6, leaves: int = 3, ridge: float = 2.0) -> Model:
    """Cycles of shallow trees over all features, then over the chosen pairs.  x may have no rows: every score is then 0.5."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for c in x.T]
    mains = [np.zeros(len(e) + 1) for e in edges]
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, float(np.log(p / (1 - p))) if len(y) else 0.0, mains)
    model.coarse = [np.minimum(np.arange(len(e) + 1) * 8 // (len(e) + 1), 7) for e in edges]
    if not len(y):
        return model
    b = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    z = np.full(len(y), model.start)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for i, t in enumerate(mains):
            if len(t) > 1:
                g, h = pull()
                step = rate * _stump(np.bincount(b[i], g, len(t)), np.bincount(b[i], h, len(t)), leaves, ridge)
                t += step
                z += step[b[i]]
    grid = lambda i, j, v: np.bincount(model.coarse[i][b[i]] * 8 + model.coarse[j][b[j]], v, 64).reshape(8, 8)
    g, h = pull()
    found = sorted(((_quad(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i, j in combinations(range(len(edges)), 2)), reverse=True)[:pairs]
    model.pairs, model.tables = [(i, j) for _, i, j in found], [np.zeros((8, 8)) for _ in found]
    for _ in range(rounds // 2):
        for (i, j), t in zip(model.pairs, model.tables, strict=True):
            g, h = pull()
            step = rate * _quad(grid(i, j, g), grid(i, j, h), ridge)[1]
            t += step
            z += step[model.coarse[i][b[i]], model.coarse[j][b[j]]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """The model of at most ``max_rows`` labelled rows, those whose ids hash lowest.

    Rows without id or label are left out; of labels that repeat an id the largest counts.  Without labels every score
    is 0.5.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "doc_id")
    kind = dict(own.dtypes)["doc_id"]
    rows = sorted((r.doc_id, r.y, list(r.x)) for r in texts.select("doc_id", "y", "text").mapInArrow(_features, f"doc_id {kind}, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect())
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], float))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_keep"), pa.array(shared.value.score(x))], names=["_id", "_keep", "_score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without the text unless ``keep_text``) with score (0 to 1, higher is better) and predicted (1 from 0.5 on).

    Null texts are scored as empty ones.  Rows that repeat are scored alike.  Other columns pass through, whatever
    their names (score and predicted are replaced).  An empty table gives an empty table.
    """
    stay = [c for c in docs.columns if c not in (id_col, "score", "predicted") and (keep_text or c != text_col)]
    struct = F.struct(*[F.col(f"`{c}`") for c in stay]) if stay else F.struct(F.lit(0).alias("none"))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), struct.alias("_keep"), F.col(f"`{text_col}`").alias("_text"))
    kind = dict(own.dtypes)
    out = own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"_id {kind['_id']}, _keep {kind['_keep']}, _score double")
    back = [F.col("_id").alias(c) if c == id_col else F.col("_keep").getField(c).alias(c) for c in docs.columns if c == id_col or c in stay]
    return out.select(*back, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
