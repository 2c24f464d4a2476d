import random

import pytest


def syllables(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["th", "an", "er", "ou", "é", "ti", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list:
    """Nulls, empty texts, white space, one word, ties, copies, near copies, long texts, odd characters."""
    r = random.Random(4)
    passage = syllables(r, 60)
    base = [syllables(r, r.randint(1, 200)) for _ in range(40)]
    odd = [None, "", "  \n\t ", "word", "a b", "x " * 50, "İ ſ K 漢字 🙂 \x1c\x85 é", "don't WE'LL they're ''s 12Ⅷ", "\x00nul", "| # $ % " * 20]
    near = [base[0] + " more", base[1].replace(" ", "\n", 3), base[0], base[0].upper()]
    shared = [f"{syllables(r, 5)} {passage} {syllables(r, 7)}" for _ in range(4)] + [f"{passage} {passage}"]
    return [*base, *odd, *near, *shared, syllables(r, 20_000)]


@pytest.fixture(scope="session")
def rows(texts) -> list:
    """(doc_id, text) with a null id, a repeated row and a doc_id with two texts."""
    out = list(enumerate(texts))
    return [*out, (None, texts[0]), (3, texts[3]), (5, "another text of five words")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with extra columns named like those that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket int, score double, _at long, y double, words string"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 0.5, 3, 0.1, "w") for i, t in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
