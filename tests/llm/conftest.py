import pytest

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 4000
#: Texts at the edges: null, empty, blank, short, repeated, long, not ASCII, odd white space.
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "b"), (5, "one two", "fr", "b"), (6, LONG, "en", "a"), (7, LONG, "en", "a"),
    (8, "Größe ÉTÉ 日本 \U0001f600 x\x0by\x0cz\r\nend a b c", "de", "c"), (8, "Größe ÉTÉ 日本 \U0001f600 x\x0by\x0cz\r\nend a b c", "de", "c"), (None, "no id here but some words of text to keep", "en", None),
    (9, "the MIT License and the mit license, and GNU General Public License too", "en", "a"), (10, "mail a.b@c.de or a@b.c_d@e.f, ip 1.2.3.4.5.6.7.8 256.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 010-2030.", "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names the operators use within."""
    rows = [(i, t, lang, source, 0, "s", 1.5, "z") for i, t, lang, source in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w string, size double, fp string")


#: Names that clash with columns within operators, or that need quoting.
ODD_NAMES = ["gone", "some", "a b", "url-hash", "row", "row_key", "k", "key", "h", "part", "again", "lang_pred", "a`b", "x.y"]


@pytest.fixture(scope="session")
def odd(edge):
    """Edge rows with many more columns."""
    from pyspark.sql import functions as F

    return edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in ODD_NAMES])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
