import pytest

EXTRA = ["_gone", "_digest", "_id", "id", "copies", "copy", "band", "_label", "count", "_text", "score", "digest", "kept"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs; ``clash`` adds columns with names that operators use."""

    def make(rows, clash=False):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        full = [(i, t, None if n % 3 == 0 else "en", None if n % 2 else "src0", None) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, schema)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in EXTRA})
        return df

    return make
