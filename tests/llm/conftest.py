import pytest

#: Whatever an operator gets may have further columns, with names that clash with its own.
EXTRA = ", text_sha256 string, row int, n int, `a` string, kind string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents frame of (doc_id, text) or (doc_id, text, lang, source) rows, with clashing columns, over a few partitions."""

    def make(rows, parts=3, extra=True):
        fields = "doc_id long, text string, lang string, source string, n_chars long" + (EXTRA if extra else "")
        more = ("x", 1, 2, "y", "z") if extra else ()
        full = []
        for doc_id, text, *rest in rows:
            full.append((doc_id, text, *(rest or ("en", "s")), None if text is None else len(text), *more))
        return spark.createDataFrame(full, fields).repartition(parts)

    return make
