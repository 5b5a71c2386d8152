import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestrata.session import build

    shared = tmp_path_factory.mktemp("shared")
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": f"file://{shared}/warehouse",
    }
    session = build("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
