import pytest

import __spark_entry__ as entry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names clash with what the operators use inside.
CLASH = "id string, start int, hash string, key string, kept string, component string, score string, _pii_found string"


@pytest.fixture(autouse=True)
def on_workers(spark):
    entry._on_workers(spark)


@pytest.fixture
def docs(spark):
    def make(texts, **more):
        rows = [
            (i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), len(t or ""))
            for i, t in (enumerate(texts) if isinstance(texts, list) else texts.items())
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        names = [c.split() for c in CLASH.split(", ")]
        return df.withColumns({n: F.lit(None).cast(k) for n, k in names if n not in df.columns})

    return add
