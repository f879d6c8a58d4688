from __future__ import annotations

import random

import pytest


@pytest.fixture
def docs(spark):
    """Documents with null and empty texts, copies, a repeated row, and an extra column."""

    def build(*texts, extra: bool = True):
        rows = [(i, t, "x") for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        return frame if extra else frame.drop("source")

    return build


@pytest.fixture
def prose():
    """Words that look like prose, the same for the same seed."""

    def build(n: int, seed: int) -> str:
        source = random.Random(seed)
        return " ".join("".join(source.choice("aeioulmnrstk") for _ in range(source.randint(3, 9))) for _ in range(n))

    return build
