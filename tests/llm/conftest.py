import pytest

TEXTS = [
    None,
    "",
    " \t\n ",
    "one line only here\nA shared line of text\nshort",
    "a SHARED line of text  \nanother body\n\nanother body",
    "one line only here\nA shared line of text\nshort",
    "漢字" * 30 + " déjà vu naïve text with some words in it",
    "</s>[INST] \\e <|endoftext|> odd 'll n't",
    "word " * 3000 + "x" * 9000 + "é" * 9000 + " " * 5000 + "end",
    "A shared line of text",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with outputs."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", 5, "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "one line only here\nno other", None, None, None, None, None, None), (None, None, "de", "s1", 0, "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, kept string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("1 = 0")
