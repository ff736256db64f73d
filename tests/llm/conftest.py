from __future__ import annotations

import pytest

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture
def make_docs(spark):
    """Documents with columns whose names the operators use inside, among them clashing ones."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, f"w{n}") for n, (i, t) in enumerate(rows)],
            "doc_id long, text string, version string, pos int, Words string",
        )

    return make
