import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, size long, row long, score double, `key` string"


def sentence(rng, words=30):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty and long texts, copies, near copies, shared lines, repeated rows, odd white space."""
    rng = random.Random(5)
    line, base = "The very same line of forty code points or more, in all.", sentence(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \n\t", "one two", "ONE  two", base, base.upper(), base, " ".join(near), sentence(rng, 20_000), "é́ ünï ß İ <|endoftext|> a　b", "a\n\nb\n", "x" * 50_000]
    texts += [f"{sentence(rng)}\n  {line if i % 2 else line.upper()}\t\n{sentence(rng)}" for i in range(6)] + [f"{line}\n{line}\nend"]
    rows = [(i, t, "en" if i % 3 else None, None if i == 4 else f"s{i % 2}", None, 1, 2, 3, 0.5, "k") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
