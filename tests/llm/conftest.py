import pytest

#: Columns that operators also produce, NULLs everywhere, equal rows, an empty, a blank and a very long text.
LONG = "lorem ipsum " * 40_000 + "token=" + "Ab1" * 5000


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, "The quick brown fox. password=abcdefghij123456", "en", "s", 46),
        (1, "The quick brown fox. password=abcdefghij123456", "en", "s", 46),
        (2, None, None, None, None), (3, "", "en", None, 0), (4, " \n\t ", None, "s", 4), (None, "No id here, but a text.", "en", "s", 23),
        (None, None, "en", "s", None), (5, LONG, "en", "s", len(LONG)), (6, LONG, "en", "s", len(LONG)), (7, "é" * 300, "fr", "t", 300),
        (8, "x" * 100_000, "en", "t", 100_000),
    ]
    clash = ["spans", "lang_pred", "score", "SHARD", "slot", "ids", "component_id", "sequence_id", "offset", "print", "key", "id", "row", "of", "line", "n", "gone"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *["taken"] * len(clash)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)
