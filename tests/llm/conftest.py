import pytest

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t ", "one", "Hello, World! hello world", "naïve Straße ΣΊΣΥΦΟΣ 日本語 テスト \U0001f600\U0001f600", "a" * 3000, "x y " * 2000,
    "tab\tand\u00a0nbsp\u2003wide  spaces \r\n\r\n end", "it's we'll DON'T 12345 3.14 <|endoftext|> <|startoftext|> &amp;", "\u0130stanbul \ufb01ne e\u0301 \u212b", "same text", "same text",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with extra columns whose names clash with the operators' own."""
    rows = [(i, t, f"src{i % 3}", "en", 0, i * 2, "x", [1]) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n_bytes long, h string, ids array<int>")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
