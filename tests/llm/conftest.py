"""Small tables with the awkward cases every operator has to take."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, score string, _part int, fp double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names used inside."""
    base = " ".join(f"word{i % 97}x{i}" for i in range(60))
    near = base.replace("word5x5 ", "other ")
    long = "\n".join(f"a{i} long text b{i * 7919 % 1009} with c{i} lines" for i in range(20_000))
    texts = [base, base, near, None, "", "  \n\t ", "one two", "one two", "Ünï cödé ẞ İ 東京   x", base + "\n" + base, long, "a\n\nb\n", "!!! ???", "\n", near.upper()]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None if t is None else len(t), "t", "s", i, 0.5) for i, t in enumerate(texts)]
    rows += [(3, None, "en", "a", None, "t", "s", None, None), (0, base, "en", "a", 1, None, None, 0, None), (None, base, "en", "a", 1, "x", "x", 1, 1.0), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
