import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text) or longer tuples; ``extra`` columns hold their own names."""

    def make(rows, extra=()):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(f"<{c}>") for c in extra}) if extra else df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in all columns, empty and white texts, a long text, ties and repeated rows."""
    words = [f"w{i % 977}x{i // 977}" for i in range(60_000)]
    long = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
    plain = "One line of some words here and more\nand another line of words that goes on for long enough"
    return [
        (1, plain, "en", "a", 1),
        (1, plain, "en", "a", 1),
        (1, plain + " differently", "en", "a", 1),
        (None, plain, None, None, None),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (2, None, "en", "a", None),
        (3, "", "en", "", 0),
        (4, " \n\t\n ", "de", "b", 5),
        (5, long, "de", "b", len(long)),
        (6, "Ärger über Öl und 𝒳 " * 30, "fr", "ü", 1),
        (7, "a", "fr", "b", 1),
    ]
