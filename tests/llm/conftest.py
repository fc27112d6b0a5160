import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None, sources=None):
        ids = ids if ids is not None else range(len(texts))
        rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def tokenizers_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path


@pytest.fixture(scope="session")
def sample_texts(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
