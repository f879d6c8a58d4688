from __future__ import annotations

import pytest

from tanteo.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def build(schema: str, *rows: tuple):
        return spark.createDataFrame(list(rows), schema)

    return build
