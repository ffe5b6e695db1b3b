import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from chainspark.session import get_spark

    session = get_spark(8, "chainspark-tests")
    yield session
    from chainspark.session import drop_scratch

    drop_scratch(session)
    session.stop()


@pytest.fixture()
def hot(spark):
    """Treat every key as hot, so the chunked path of the scans runs."""
    spark.conf.set("spark.chainspark.hotRows", "1")
    yield spark
    spark.conf.unset("spark.chainspark.hotRows")
