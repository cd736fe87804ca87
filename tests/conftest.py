import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="run-", dir="/tmp"))


@pytest.fixture(scope="session")
def spark():
    from tickwright.session import local_session
    session = local_session("8", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from tickwright.plans.fixtures import Fixtures
    return Fixtures(spark, "/root/testdata/sf0.001")


@pytest.fixture
def make_bars(spark):
    """Bars from {symbol: [close, ...]} on consecutive days, or {symbol: {date: close}}."""
    from datetime import date, timedelta

    from tickwright import schemas

    def make(closes, volume=100):
        rows = []
        for symbol, values in closes.items():
            if not isinstance(values, dict):
                values = {date(2020, 1, 1) + timedelta(days=i): c for i, c in enumerate(values)}
            for day, c in values.items():
                day = date.fromisoformat(day) if isinstance(day, str) else day
                rows.append((symbol, day, c, c, c, c, c, volume))
        return spark.createDataFrame(rows, schemas.BARS)
    return make
