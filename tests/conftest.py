from datetime import datetime

import pytest

from fcverify.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def at():
    """A timestamp from its parts; the session runs in UTC."""
    from datetime import timezone

    return lambda *parts: datetime(*parts, tzinfo=timezone.utc)
