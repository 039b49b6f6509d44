import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grainguard.plans.sorted_chunks import HOT_KEY_SETTING  # noqa: E402
from grainguard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g")


@pytest.fixture
def many_chunks(spark):
    """Keep small range partitions apart, so keys really cross chunk borders."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.set(setting, "true")


@pytest.fixture
def every_key_hot(spark, many_chunks):
    """Send ranks and as-of lookups down the path for hot keys."""
    spark.conf.set(HOT_KEY_SETTING, "0")
    yield
    spark.conf.unset(HOT_KEY_SETTING)
