import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, ids string, score string, size int, spans string, keep_id string, shard int, id string, `to` string"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with operators' own."""
    base = "The quick brown fox jumps over the lazy dog near the river bank on a sunny day in June while birds sing. "
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60000))
    texts = [base, base.upper(), base + "End", "", None, " \t\n", "one two", "One Two", long, long + " tail", "é" * 5000, "line\nline\nline\nother", 'token = "abc123def456" x', "AKIA" + "A1" * 10, "0123456789abcdef" * 2, "\\### Assistant: </turn> ok", "日本語 テキスト 🙂🙂", base]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, 1, "b", None, "s", 2, None, "k", 3, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base, None, None, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
