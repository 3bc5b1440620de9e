import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from taskspan.session import local_session  # noqa: E402
from taskspan.sources import mapping  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "taskspan-tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def source(spark):
    return mapping.warehouse(spark, SF)


@pytest.fixture(scope="session")
def calendar(spark):
    return mapping.calendar_between(spark, 1995, 2003).cache()
