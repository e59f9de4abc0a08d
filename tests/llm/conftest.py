import pytest

#: Columns that an input may carry under names that operators use inside.
CLASHING = ", k string, t int, id long, key string, spans int, ids string, score int, media int, text_a string, number int, _parts string, bands int"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with clashing extra columns."""

    def build(rows):
        full = [(i, t, None, None, None, *[None] * (CLASHING.count(","))) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + CLASHING)

    return build


@pytest.fixture
def odd_rows():
    """Nulls, empty, blank, short, repeated and very long texts."""
    long = " ".join(f"word{i % 977} and{i % 31}." for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "été ñ ß 中文 🙂"), (6, "same text here"), (6, "same text here"), (7, long), (8, "a" * 5000), (9, "Ab, cd! " * 300), (None, "no key at all")]
