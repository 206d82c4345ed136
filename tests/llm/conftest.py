import pytest
from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, source) as a table like ``documents``."""

    def make(rows, **extra):
        schema = T.StructType(T._parse_datatype_string(DOCUMENT).fields)
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
