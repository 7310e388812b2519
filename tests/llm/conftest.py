import random

import pytest

#: One doc_id per row, but for the last: nulls, empty and odd texts, exact copies, repeats within a text, and rows
#: that repeat wholly. Extra columns clash with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, id long, score double, label int, spans string, bucket int, recipe string, n_tokens long, `__t` int"


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def odd_texts():
    passage = words(1, 60)
    return [
        (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "two words"), (5, passage), (6, passage), (7, words(2, 30) + " " + passage + " " + words(3, 30)),
        (8, "la " * 300), (9, "ab cd " * 100), (10, words(4, 5000)), (11, "naïve café Ünïcode ÉCOLE straße 東京 🙂 " * 8),
        (12, passage.upper()), (13, words(5, 19)), (14, words(5, 20)), (15, words(5, 20) + " x"), (16, "x" * 50_000),
        (17, words(6, 40).replace("w1", "v1")), (18, words(6, 40)), (None, passage), (None, None), (19, "a\x0bb\x0cc\rd\x1ce\x85f g"), (20, words(4, 5000)),
        (21, words(7, 25)), (21, words(7, 25)), (21, words(8, 25) + " " + words(7, 25)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 1, 2, 3, 0.5, 1, "x", 1, "r", 5, 9) for i, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
