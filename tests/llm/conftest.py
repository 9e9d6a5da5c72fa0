from __future__ import annotations

import random

import pytest

WORDS = "the of and water stone river Äpfel über été niño house light 12 7.5 under tree cloud sand".split()


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.choice(WORDS)}{r.randint(0, 9)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in any column, empty and blank and long texts, ties, repeats, extra columns."""
    base = prose(1)
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, base.replace(" ", "  \n", 3), "en", None),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n", "de", "b"),
        (6, prose(6, 4000), "de", "b"),
        (7, prose(2) + " changed", "en", "b"),
        (8, prose(2), "en", "b"),
        (9, "Short one.", "fr", "b"),
        (10, "12 + 34 = 46", "fr", "b"),
        (11, prose(3) + "\n" + prose(4), "es", "c"),
        (12, prose(5) + "\n" + prose(4), "es", "c"),
        (13, "漢字 😀 " + prose(9), "es", "c"),
        (14, base, "en", "a"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "extra", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, label string, kept int")
    return frame.cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
