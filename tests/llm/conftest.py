import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "One two three four. " * 40_000  # 800,000 characters


@pytest.fixture
def documents(spark):
    """A table of documents from texts, with ids from 0 or as given."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        return spark.createDataFrame([(i, t, g, None, len(t) if t else None) for i, t, g in zip(ids, texts, langs, strict=True)], KIND)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Write tables into a folder, as the queries read them."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
