import random

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, n long, pid long, row string, bucket int, kept string, score double, slot long, bucket_rows int, id long, part int, list int, label string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twin = text(20_000), text(60)
    texts = [None, "", " \n\t ", "one", "é ü ß 東京 🎉", twin, twin, twin.replace("word1", "other1", 1), long, long[: len(long) // 2], "a" * 3000, "x\n" * 200, text(30), text(300)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, text(40), None, None, None), (None, None, None, None, None), rows[5], rows[12], (12, text(25), "en", "s1", 3)]
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "r", 4, "no", 0.5, 6, 7, 8, 9, 10, None) for r in rows], CLASH)


@pytest.fixture(scope="session")
def tagged(spark):
    return spark.createDataFrame([(12, 1, 0), (13, 1, 1), (5, 1, 0), (10, 0, 1), (None, 1, 1), (8, None, None), (12, 1, 0)], "doc_id long, quality int, toxic int")
