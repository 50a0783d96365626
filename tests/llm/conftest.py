import pytest

from prepkit.llm.common import tuned


@pytest.fixture
def docs(spark):
    """Documents (doc_id, text, lang, source, n_chars) from rows (id, text, source)."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return tuned(spark).createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return make
