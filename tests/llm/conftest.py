import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(300)]
    long_text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(900))
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = [
        (1, None, "en", "s"), (2, "", None, None), (None, "a text without an id", "en", "s"), (None, None, None, None), (3, "   \n\t\n ", "de", "s"),
        (4, long_text, "en", "s"), (5, long_text, "en", "s"), (5, long_text, "en", "s"), (6, passage + "\nown line six", "en", "s"), (7, "first\n" + passage, "fr", "s"),
        (7, "another text of seven", "fr", "s"), (8, "é" * 5000, "fr", "s"), (9, "x", "en", "s"), (9, "x", "en", "s"), (10, "日本語 テキスト 😀 ▁ <s> <|endoftext|>", "ja", "s"),
        (-3, "a\x00b \x1c c\x85d", "en", "s"), (11, passage.upper(), "en", "s"), (12, "!!! ... 12 345", "en", "s"), (13, passage + " " + passage, "en", "s"), (14, " ".join(words), "en", "s"),
    ]
    full = [(i, t, a, b, None if t is None else len(t), 7, "mine", 0.5, True, [1], "k") for i, t, a, b in rows]
    extra = ", fp long, n_words string, score double, rejected boolean, spans array<int>, n_lines string"
    return spark.createDataFrame(full, DOC + extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
