import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, id string, n_tokens string, size int, fingerprint int"


def rows(pairs, sources=("a", "b", None)):
    return [(i, t, "en", sources[k % len(sources)], None, 7, "x", "y", 3, 1) for k, (i, t) in enumerate(pairs)]


ODD = [
    (5, "Hello there, it's a <|endoftext|> test."), (3, None), (4, ""), (None, "no id at all"), (7, "  \t\n "),
    (7, "  \t\n "), (7, "twice"), (-2, "naïve 漢字 é   x \ty \x1c!"), (9, "word " * 30_000), (10, "x" * 50_000),
    (11, "Hello there, it's a <|endoftext|> test."), (12, "</s>[INST] a\\b <|im_start|>"), (13, "a"), (14, "\u0085 　 \n\n b"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, odd characters, and columns with clashing names."""
    return spark.createDataFrame(rows(ODD), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
