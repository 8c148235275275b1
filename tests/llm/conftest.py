import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """Writes texts as documents.parquet and gives (DataFrame, folder)."""

    def make(texts, langs=None, ids=None, extra=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or [None] * len(texts)
        rows = [(i, t, g, "src", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        df = spark.createDataFrame(rows, DOCS)
        for name, kind in (extra or {}).items():
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
        d = str(tmp_path_factory.mktemp("docs"))
        df.repartition(3).write.mode("overwrite").parquet(f"{d}/documents.parquet")
        return spark.read.parquet(f"{d}/documents.parquet"), d

    return make
