import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of given (doc_id, text[, lang, source]), with columns that clash with operators' own."""
    import pyspark.sql.functions as F

    def table(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        return df.withColumns({c: F.lit("x") for c in ("id", "n", "size", "sha", "token", "component", "score", "key", "bucket", "_text", "h", "level")})

    return table
