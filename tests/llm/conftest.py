import pytest

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeated rows, odd white space, a long text, special-token strings.
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "   \n\t ", None, "s"), (4, "one two three", "en", None), (5, "one two three", "en", "s"), (5, "one two three", "en", "s"),
    (6, "a b c d e f g h i j k l m n o p", "de", "t"), (7, "a  b  c d \r\n e\x0bf\x0c <|endoftext|> <|startoftext|> <unk>", "de", "t"), (8, "0123 é É ß ΑΣ İ 中文字 🙂🙂 é \x00 x", "fr", "t"), (9, "word " * 30_000, "en", "s"), (10, "!!! ... ---", "en", "s"), (11, "\nlead\n\nlead\n", "en", "s"), (12, "zz   y　 　z  ", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, size string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
