from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents (doc_id, text) with further columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "src0", 0, 9, "x", 0.5, True) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, toxicity double, kept boolean")

    return make
