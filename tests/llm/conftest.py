import pytest

#: Texts for the hard cases: null, empty, blank, short, repeated, long, not ASCII, marks that a format might misread.
HARD = [None, "", "   \n\t", "a", "a b c d e", "a b c d e", "A B C D E", "word " * 3000, "naïve Ünïcödé — ☃ 中文 é́", "x" * 5000, "<|endoftext|> <|end|>\r\nWARC/1.1\r\n\r\n", "the cat sat on the mat " * 20]


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in any column, repeated rows, equal texts and extra columns whose names clash with the operators'."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t) if t else None, "x", i, 1.5, True) for i, t in enumerate(HARD)]
    rows += [rows[4], rows[7], (None, "a b c d e f g", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, name long, score double, node boolean").repartition(3)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
