import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} tail" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (1, "", "en", 1.0, "a"), (2, "   \n\t ", "en", None, "b"),
        (3, long_text, "en", 2.0, None), (4, "a", "de", 3.0, "c"), (4, "a", "de", 3.0, "c"),
        (5, "a", None, 4.0, "d"), (None, "some text without an id", "en", 5.0, "e"),
        (6, "12 34 !!", "en", 6.0, "f"), (7, "x\n\nx\nx", "fr", 7.0, "g"),
    ]
    schema = "doc_id long, text string, lang string, _found double, node string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def words():
    """A maker of repeatable nonsense words."""
    def make(seed, n):
        draw = random.Random(seed)
        return ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
                for _ in range(n)]
    return make
