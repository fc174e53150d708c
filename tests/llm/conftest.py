import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, one word, very long, copies, near copies, odd spaces, several scripts."""
    rng = random.Random(8)
    plain = [_prose(rng, rng.randint(1, 200)) for _ in range(40)]
    near = []
    for t in plain[:12]:
        words = t.split(" ")
        for k in range(0, len(words), 40):
            words[k] = "changed"
        near.append(" ".join(words))
    odd = [None, "", "   ", "word", "  two  spaces \n and\tmore ", "don't I'll 's\0'x", "日本語 текст ñandú ²³", "a b c d e f", "A B C D E F", "x" * 30_000, _prose(rng, 6000), " lead", "trail ", "<|endoftext|> x", "1234 ٣٤ ½"]
    return plain + plain[:6] + near + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(3 * i + 1, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
