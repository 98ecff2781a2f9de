"""Language identification by rank-order profiles.

A profile lists a text's most frequent character n-grams (1 to 3) by rank; a document goes to the language whose profile
has the least out-of-place distance.  N-grams are packed into 64-bit integers, so a document is profiled with a sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400  # n-grams of a profile
CHUNK = 1 << 20  # characters that are counted at once


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters than letters is one space, also around it."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[32], np.where(_is_letter()[codes], codes, 32), [32]]).astype(np.uint64)
    return codes[np.concatenate([[True], ~((codes[1:] == 32) & (codes[:-1] == 32))])]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams, counts) of a text; none if it has no letter."""
    c = letters(text)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.uint64(21)
    keys, counts = [], []
    for i in range(0, len(c), CHUNK):
        x = c[i : i + CHUNK + 2]
        own = min(CHUNK, len(c) - i)
        two, three = x[:-1] << s | x[1:], (x[:-2] << s | x[1:-1]) << s | x[2:]
        k, n = np.unique(np.concatenate([x[:own][x[:own] != 32], two[:own], three[:own]]), return_counts=True)
        keys.append(k)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        stay = counts >= least
        keys, counts = keys[stay], counts[stay]
    return keys[np.lexsort((keys, -counts))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, n-gram) over a task's rows, summed whenever a million have come together."""
    waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            k, n = grams(text)
            if len(k):
                waiting.setdefault(lang, []).append((k, n))
                held += len(k)
        if held > 1_000_000:
            yield from flush()
            held = 0
    yield from flush()


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 4000) -> dict[str, np.ndarray]:
    """language -> its ranked n-grams, learned from about ``docs_per_lang`` documents of each, those whose ids hash lowest.

    Rows without language are left out.  A profile has PROFILE n-grams at most, so what is broadcast or
    comes to the driver is bounded by the number of languages.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("lang is not null")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.ceil(F.lit(docs_per_lang * 1e6) / F.col("n"))
    sample = own.join(F.broadcast(sizes), "lang").filter(share).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("gram")]
    piece = Window.partitionBy("lang", F.pmod("gram", F.lit(31))).orderBy(*order)  # first in pieces, so that no task sorts a language
    top = counts.withColumn("rank", F.row_number().over(piece)).filter(F.col("rank") <= PROFILE)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.uint64) for lang, g in out.items()}


class Judge:
    """All profiles in one sorted table: n-gram -> its rank in every language."""

    def __init__(self, known: dict[str, np.ndarray]) -> None:
        self.langs = sorted(known)
        self.keys = np.unique(np.concatenate([known[x] for x in self.langs])) if known else np.empty(0, np.uint64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, known[lang]), i] = np.arange(len(known[lang]))

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 - distance / the largest distance possible; the first language in order on ties."""
        own = ranked(*grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        found = self.rank[np.where(self.keys[at] == own, at, len(self.keys))]
        place = np.arange(len(own))[:, None]
        far = np.where(found < 0, PROFILE, np.minimum(np.abs(found - place), PROFILE)).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1 - float(far[best]) / (PROFILE * len(own))


def _decide(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            done = [judge.decide(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of docs.

    lang_pred is ``und`` with score 0 for null texts, texts without letters, and where no language was learned.  Rows
    that repeat get the same answer; an empty table gives an empty table.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(_decide(docs.sparkSession.sparkContext.broadcast(known)), f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double")
