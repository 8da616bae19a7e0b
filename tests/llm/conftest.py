import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Texts with every kind of trouble: null, empty, white space only, one long, repeated rows, clashing columns."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [
        (1, None, "en", "src1", 0),
        (2, "", "en", "src1", 0),
        (3, " \t\n ", None, None, 3),
        (4, "one", "de", "src2", 3),
        (5, long, "en", "src0", len(long)),
        (6, long, "en", "src0", len(long)),
        (7, "the same row twice over and over", "en", "src0", 32),
        (7, "the same row twice over and over", "en", "src0", 32),
        (8, "na " * 200, "fr", "src0", 600),
        (9, "Ünï ﬁ 日本 \x00\x01 😀 ▁x \x1c", "xx", "src.9", 20),
        (None, "no name but some words in it", "en", "src1", 28),
        (None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 AS node", "2 AS `key`", "3 AS root", "'c' AS class", "4 AS n", "5 AS stratum", "6 AS budget", "7 AS `a.b`"
    )


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
