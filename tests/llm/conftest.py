from __future__ import annotations

import pytest
from rows import as_documents, messy_rows


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from edupulse.llm.staging import ship_library

    ship_library(spark)


@pytest.fixture(scope="session")
def messy(spark):
    return as_documents(spark, messy_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return as_documents(spark, [])
