import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use for columns of their own.
        T.StructField("score", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("ranges", T.StringType()),
        T.StructField("wanted", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table with columns of clashing names, from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "s", "k", "z", "r", "w"))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def table(spark):
    """Writes rows of ``documents`` (or any frame) as the tables of a folder."""

    def write(folder, **tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
