import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string, size string"


@pytest.fixture(scope="session")
def spark():
    from tallywork.session import local_session

    session = local_session()
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-tests-"))
    return session


@pytest.fixture
def documents(spark):
    """Frames like documents, with a column whose name an operator also uses."""
    def make(rows):
        full = [(i, t, lang, source, len(t or ""), "x", "clash") for i, t, lang, source in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make
