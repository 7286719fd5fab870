import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean, _text string"


def prose(seed, n, words=None):
    rnd = random.Random(seed)
    vocabulary = words or ["the", "river", "stone", "was", "over", "A", "Green", "hill", "morning", "light.", "path,", "of", "old", "house", "winter", "rain"]
    return " ".join(rnd.choice(vocabulary) + str(rnd.randrange(40)) * (rnd.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows; columns named as the operators' own."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", None, 1), (4, prose(2, 300), "en", "b", 1),
        (5, "", "en", "b", 1), (6, None, None, None, None), (7, " \t\n", "de", "a", 0), (8, "one", "de", "c", 3), (9, "one", "de", "c", 3),
        (10, "x" * 5000, None, "a", 1), (11, prose(3, 20000), "en", "a", 1), (12, "Schöne Grüße über Straßen und Bäume " * 12, "de", "b", 1),
        (13, "der die und nicht mit von zu eine Häuser schön ist auch noch weiter gehen wir heute", "de", "b", 1), (13, "der die und nicht mit von zu eine Häuser schön ist auch noch weiter gehen wir heute", "de", "b", 1),
        (14, "тест на русском языке", "ru", "c", 1), (15, "### $$$ *** 123 456", "en", "c", 1), (16, "line a b\nline a b\nline a b\n", "en", "c", 1),
        (None, prose(31, 80), "en", "b", 1), (None, prose(31, 80), "en", "b", 1), (None, prose(32, 80), "en", "b", 1),
        (17, "a<|endoftext|>b  c\u2003d 's don't\r\n\r\n", "en", None, 1), (18, prose(4, 600, ["ab", "cd"]), "en", "b", 1),
    ]
    return [(*r, 7, 0.5, None, "other") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
