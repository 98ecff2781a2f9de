from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "Und", "los"]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, repeated lines, shared passages, nulls and empties."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randint(1, 160))) for _ in range(60)]
    line = "  This LINE stands in many documents, word for word.\t"
    texts += [f"{' '.join(words(rng, 30))}\n{line}\n{' '.join(words(rng, 5))}\r" for _ in range(8)] + [line.strip().lower()]
    texts += [texts[3]] * 4 + [texts[5] + " " + texts[6]]
    long = words(rng, 300)
    for k in range(3):
        near = list(long)
        near[10 + 90 * k] = "changed"
        texts.append(" ".join(near))
    shared = " ".join(words(rng, 70))
    texts += [" ".join(words(rng, 40)) + " " + shared + " " + " ".join(words(rng, 40)) for _ in range(3)]
    texts += [None, "", " \n\t ", "ß", "Grüße an die Welt\n\nzwei", "a" * 3000, "日本語のテキスト です", "12 34", "\n\n"]
    return [(i, t, None if i % 11 == 0 else "en" if i % 3 else "de", [None, "a", "b", "Z"][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """The same rows with columns that operators use inside or return."""
    names = ["size", "shard", "slot", "key", "fp", "rep", "score", "predicted", "ids", "n_lines", "_id", "_text", "bundle", "rate", "copies"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in corpus], SCHEMA + "".join(f", {n} int" for n in names))
