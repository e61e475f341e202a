import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, blob string, ids string, _words string"


@pytest.fixture(scope="session")
def prose():
    """Invented texts: mostly English or German words, a fixed number each."""
    rng = random.Random(4)
    words = {
        "en": "the of and to in is that it for was with house river green walking little morning people water never".split(),
        "de": "der die das und ist den von zu mit sich haus fluss grün wandern kleine morgen leute wasser niemals über".split(),
    }

    def make(lang, count):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "", ",", "."]) for _ in range(count))

    return make


@pytest.fixture(scope="session")
def edge(spark, prose):
    """Nulls in every column, empty and long texts, ties, repeated rows and names that operators use themselves."""
    same = prose("en", 80)
    rows = [
        (1, None, "en"),
        (2, "", "en"),
        (3, " \n\t ", None),
        (None, prose("en", 60), "en"),
        (4, " ".join(["long"] + [prose("de", 40)] * 500), "de"),
        (5, same, "en"),
        (5, same, "en"),
        (6, same, "en"),
        (7, "x" * 100_000, None),
        (9007199254740993, prose("de", 70), "de"),
        (8, "é漢😀 <|endoftext|> \u0000 <s> ▁▁ a  b   c", None),
    ]
    extra = [None, 1, "clash", "clash", "clash", None, "clash", "clash"]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
