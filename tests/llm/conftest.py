import pytest

#: Texts that every operator must take: null, empty, blank, one word, marks, long, repeated, other scripts, specials.
ODD = [None, "", " \t\n", "word", "!!! ??? |", "a b c " * 3000, "a b c " * 3000, "日本語 テキスト", "<|endoftext|> it's <|startoftext|>O'Neil’s", "x" * 5000, "line one\nline two\r\nline one\n\n", "\x1c\x85 nbsp", "É́ ǅ İ ﬁ", "A" * 40 + " " + "B!! " * 60]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null and a repeated doc_id, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "src", 1, "clash", 2, 3) for i, t in enumerate(ODD)]
    rows += [(None, "a row without an id", "en", None, 1, None, None, None), (3, "word", "en", "s", 1, "x", 1, 1), (3, "another text of three", "en", "s", 1, "x", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, run int, score int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
