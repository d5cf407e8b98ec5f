from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, runs int"


def prose(rng: random.Random, n: int, letters: str = "aeioulmnrst") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_for(texts: list, langs: list | None = None, first: int = 0) -> list[tuple]:
    """Rows with columns that clash with names the operators use."""
    return [(i + first, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or ""), "x", i) for i, t in enumerate(texts)]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


#: Nulls, empty and blank texts, one very long text, a repeated row, a null id.
@pytest.fixture
def odd():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = rows_for([None, "", " \n\t ", long, "One word.", "ünï cödé 　 日本語 x", "a  b   c"])
    return [*rows, rows[4], (None, "no id here", None, None, None, None, None)]
