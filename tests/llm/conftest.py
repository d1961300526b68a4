import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(os.path.dirname(HERE))]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents: nulls, empty and long texts, copies, repeated rows, clashing extra columns."""
    base = "The quick brown fox jumps over the lazy dog while seven wise owls count small bright stars above the old grey mill near town "
    base += " ".join(f"plain{i}" for i in range(50)) + " "
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(4000))
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s0"), (3, base + "and then some other words follow it here", "en", "s1"),
        (4, None, "en", None), (5, "", None, "s1"), (6, " \n\t ", "en", "s1"), (7, "x", "en", "s2"), (8, "x", "en", "s2"),
        (9, long, "en", "s0"), (10, long + " " + base, "de", "s0"), (11, "été ☃ \U0001f600 naïve " * 30, "fr", "s2"),
        (None, base + "a text without an id", "en", "s2"), (12, "same line\nsame line\nother line\n\n#*$ %&|<>", "en", "s1"),
        (13, "a b c\x1cd\u0085e", "en", "s1"), (14, "   double  spaces   here \n end<|endoftext|> ", "en", "s1"),
        (1, base, "en", "s0"), (15, base * 3, "en", "s0"),
    ]
    data = [(*r, len(r[1] or ""), "extra", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, part int")


@pytest.fixture(scope="session")
def plain(docs):
    """The same without the row given twice, as (id, text)."""
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:-2] + [(15, docs.where("doc_id = 15").first()["text"])]
