import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyslot.session import build

    own = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    session = build("local[8]", **own)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
