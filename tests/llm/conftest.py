import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use inside.
ODD = "row long, leaf int, ids string, tie string, shard string, block string, start string, w string, n string, fingerprint string, component_id string, size string, score string, key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and very long texts, ties, repeated rows and ids, and null ids."""
    long_run = "ab'sxyz" * 4000
    prose = "the quick brown fox, jumps over the lazy dog's 12 bones. " * 700
    texts = [
        (1, "the cat sat on the mat"), (2, None), (3, ""), (4, " "), (5, "  \n\n\t  x  "), (6, "the cat sat on the mat"),
        (6, "the cat sat on the mat"), (6, "another text"), (None, "no id at all"), (None, None), (7, long_run),
        (8, prose), (9, "你好 世界 😀 é ́ ß"), (10, "a<|endoftext|>b <|endoftext|> c"), (11, "!!!'s ... 12345"),
        (-5, "minus"), (2**60, "far"), (12, "x" * 40_000), (13, prose + "<|endoftext|>" + long_run), (14, "Z"),
    ]
    langs = ["en", None, "de", "en"]
    return [(i, t, langs[k % 4], "src0", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = T._parse_datatype_string(SCHEMA + ", " + ODD)
    extra = len(schema) - 5
    return spark.createDataFrame([r + (None,) * extra for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def folder_of(tmp_path_factory):
    """Writes tables into a folder that queries can read."""

    def make(**tables):
        at = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return make
