import os
import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Columns that the operators use inside, or that a user may have.
CLASHES = ("row", "class", "n", "label", "leaks", "id", "keys", "digest", "copies", "rate", "part", "slice")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def words():
    dice = random.Random(1)
    return ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randint(3, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Rows (doc_id, text): nulls, empty, white space only, very long, ties, repeated rows and ids."""
    dice = random.Random(2)
    base = " ".join(dice.choices(words, k=120))
    long = " ".join(dice.choices(words, k=60_000))
    near = base.replace(base.split()[60], "changed")
    return [
        (1, base), (2, base), (3, base.upper()), (4, near), (5, None), (6, ""), (7, " \t\n "), (8, long), (9, long + " end"),
        (10, "one two"), (11, "One  two"), (12, "one two three four five"), (13, " ".join(dice.choices(words, k=200))),
        (13, " ".join(dice.choices(words, k=200))), (14, base), (14, base), (None, base), (None, None), (None, "lonely text without an id here"),
        (15, "é" * 10), (16, "<|endoftext|> x"), (17, "1234 ... !!!"), (18, "\x1c\x1f\x85 "), (19, base.replace(" ", "\n")),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    """The rows above with nulls in the other columns, and columns of clashing names."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    rows = [(i, t, None if k % 3 else "en", None, None, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(odd_rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    assert len(names) == len(rows[0])
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes a DataFrame to a Parquet folder and gives its path."""

    def write(df):
        path = os.path.join(tmp_path_factory.mktemp("stored"), "table.parquet")
        df.write.parquet(path)
        return path

    return write
