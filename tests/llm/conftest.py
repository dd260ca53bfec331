import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, base, "en", "b", 10), (4, base, "en", "b", 10), (5, base + " phi", "en", "c", 10),
            (None, "no id here", "en", "c", 1), (6, "one", "en", "c", 3), (7, ("word " * 9000) + base, "de", "a", 9), (8, "Naïve K K 中文 all rights reserved 😀\r\n", "fr", "é", 9), (9, "x" * 50_000, "en", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "score", "bucket", "vec_id", "_size", "hashes", "t", "n", "w", "key", "block", "shard"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
