import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs([(id, text), ..])`` or ``docs([(id, text, source), ..])``: a table like ``documents``."""

    def build(data, schema=DOCS):
        full = [(d[0], d[1], "en", d[2] if len(d) > 2 else "a.example", len(d[1] or "")) for d in data]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def folder(spark, tmp_path):
    """``folder(documents=df, ..)``: a folder of Parquet tables for registered queries."""

    def build(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build
