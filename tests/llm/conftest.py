import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names operators use inside."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        if extra:
            for name in ("fp", "key", "of", "kept", "host", "row", "shard", "n", "digest", "part", "component", "n_words"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows."""
    prose = " ".join(f"word{i % 97}x{i}" for i in range(120))
    rows = [
        (1, prose, "a"),
        (2, prose, "a"),
        (2, prose, "a"),
        (3, None, None),
        (4, "", "a"),
        (5, "one", "b"),
        (None, "no id here at all", None),
        (6, "x " * 60_000, "b"),
        (7, " \n\n \t ", "b"),
        (8, "## && %% " * 40, "b"),
        (-9, prose + " tail", None),
        (10, "ÀÉ " + "é" * 3000 + "   z", "b"),
        (11, "Line one.\nLine one.\n\n\nLine   one.\r\n", "b"),
        (12, "<|endoftext|> don't 漢字 \U0001f600 ﬁ", "b"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
