import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillgraph.session import build_session

    session = build_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
