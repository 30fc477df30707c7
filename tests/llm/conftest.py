import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or longer tuples."""
    def build(rows, extra=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra or ():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(1))
        return df
    return build
