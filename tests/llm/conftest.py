import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, or give their own columns.
CLASHES = ["fp", "fingerprint", "component_id", "size", "count", "key", "twin", "at", "n", "all", "term", "score", "held_out", "lang_pred", "spans", "label", "block", "value", "source_size", "target", "taken", "copies", "c0", "c1", "toxic_", "words", "first"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in each column, blanks, a very long text, ties, repeats and further columns."""
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log", "en", "a", 10),
        (2, "the cat sat on the mat and the dog sat on the log", "en", "a", 10),
        (2, "the cat sat on the mat and the dog sat on the log", "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n\x0b ", "fr", "b", 5),
        (None, "le chat est sur la table et le chien dans la rue", "fr", None, 5),
        (None, None, None, None, None),
        (6, "été ÉTÉ ñandú 𝒳𝒴 日本語 ß", "fr", "b", 5),
        (7, "wort " * 60_000, "de", "c", 300_000),
        (8, "x" * 100_000, "de", "c", 100_000),
        (9, "1234 5678 !!! ...", "de", "c", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(k))
    return df


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)
