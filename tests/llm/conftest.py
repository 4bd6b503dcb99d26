import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, white space alone, repeated rows, ties, multi-byte letters, a long word and a long text.
HARD = [(5, "b a  b\n\nb a b", "en", "s", 1), (3, None, "en", None, None), (None, "null id", None, "s", 1), (9, "", "fr", "s", 0),
        (5, "b a  b\n\nb a b", "en", "s", 1), (7, " \t\n ", "de", "s", 4), (1, "Éa çà été ñandú 东京 <|endoftext|> it's 12.5%", "fr", "s", 1),
        (2, "x" * 5000, "en", "s", 1), (8, "word " * 3000, "en", "s", 1), (4, "b a  b\n\nb a b", "en", "t", 1),
        (-6, "trailing space ", "en", "s", 1), (12, "a  b  c d   e", "en", "s", 1)]


@pytest.fixture()
def hard_docs(spark):
    from pyspark.sql import functions as F
    # extra columns with names that operators use themselves
    return spark.createDataFrame(HARD, DOCS).withColumns({
        "shard": F.lit("own"), "size": F.lit("own"), "length": F.lit(1), "tokens": F.lit(2), "t": F.lit(3), "d": F.lit(4), "kept": F.lit(5)})


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def sample(name="documents", sf="0.01"):
    import pyarrow.parquet as pq
    return pq.read_table(f"/root/testdata/sf{sf}/{name}.parquet").to_pylist()
