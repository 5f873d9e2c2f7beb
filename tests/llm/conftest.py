"""Small awkward tables, and the real ones at the smallest size."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hits string, items string, n long, cell int, node long"
LONG = "Wort " * 9000 + "größer  \n\n than\tthis’s it's 'Quoted' x²5 12345 ½ ﬁne " * 50
TEXTS = [
    None, "", " ", "\n", "a", "It's", "  double  spaces \n \n here  ", "Ünïcode ÀÉ ǅ ß 東京 مرحبا 👩‍👩‍👧 é", "tab\tsep\x1cfs\x1fus nbsp\xa0end\x85",
    "<|endoftext|> </s> ▁piece ▁▁", LONG, LONG, "x" * 5000, "word word word word", "don't DON'T I'LL we've 'tis 's",
]


def awkward_rows():
    rows = [(i, t, "en" if i % 2 else None, "s", None, "clash", "clash", i, 1, 2) for i, t in enumerate(TEXTS)]
    return rows + [rows[4], rows[4], (None, "null id", *[None] * 8), (2**53 + 1, "big id", "de", None, 7, *[None] * 5)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
