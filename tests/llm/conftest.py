import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, lines string, kept_text string, h string, component_id long, text_hash long"
WORDS = "tion ing the and ore est hen wha lyb ere ant iou sto ran del mip quor vex zan hul".split()
LINE = "this line of boilerplate is long enough to count as repeated"


def row(doc_id, text):
    """Columns beyond doc_id and text clash with names that the operators use inside."""
    return (doc_id, text, "en", "src", len(text or ""), 0.5, "k", "l", "t", "h", 7, 9)


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, base), (5, base), (5, base), (6, base.replace("tion", "TION", 1)), (None, base), (None, None)]
    rows += [(7, prose(rng, 60_000)), (8, "x" * 150_000), (9, "a." * 40_000 + "@b.c"), (10, "\n" * 5000), (11, "日本語 text é ß <|endoftext|> İ 𝒳")]
    rows += [(20 + k, f"{prose(rng, 40)}\n{LINE.upper() if k % 2 else LINE} \n{prose(rng, 30)}\n{LINE}") for k in range(12)]
    words = base.split()
    words[50] = "changed"
    rows += [(40, " ".join(words)), (41, "4111 1111 1111 1111 and a.b@c.de, 10.0.0.255 +1 (555) 555-0100")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([row(*r) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in (*range(12), *range(20, 32))] + [(4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, odd_rows):
    words = odd_rows[4][1].split()
    return spark.createDataFrame([(1, " ".join(words[10:40])), (2, None), (3, "too short"), (4, " ".join(words[10:40])), (5, "never seen " * 10)], "item_id long, text string")
