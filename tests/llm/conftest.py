from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    from roadpulse.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@pytest.fixture(scope="session")
def documents(shipped):
    """Makes documents from (id, text, source) rows."""

    def make(rows):
        return shipped.createDataFrame([(i, t, None, s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)

    return make


#: Nulls in any column, empty and blank texts, a long text, repeats.
ODD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \n\t ", "a"),
    (None, "one two", "b"),
    (5, "word " * 20000, "b"),
    (6, "tie tie", None),
    (6, "tie tie", None),
    (7, "\x00 nul é漢 \x85 x", "a"),
]
