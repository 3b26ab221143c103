"""One local session for all tests."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from docfathom.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.execution.arrow.maxRecordsPerBatch": "200"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
