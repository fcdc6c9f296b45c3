import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents of given (doc_id, text) or (doc_id, text, lang), with columns whose names clash with those that operators add."""

    def make(rows):
        df = spark.createDataFrame([(i, t, x[0] if x else "en", "s", len(t or "")) for i, t, *x in rows], SCHEMA)
        for name in ("fp", "score", "component_id", "lang_pred", "rank", "piece", "words", "rid", "part", "own", "_nth", "p_good"):
            df = df.withColumn(name, F.lit("x"))
        return df.repartition(3, "doc_id")

    return make
