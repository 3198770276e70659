import os
from pathlib import Path

import pytest

from waymark import get_session


# Python workers import model classes that tests define.
HERE = Path(__file__).parent
os.environ["PYTHONPATH"] = os.pathsep.join(
    filter(None, [str(HERE), str(HERE.parent), os.environ.get("PYTHONPATH")])
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "waymark-tests",
        master="local[4]",
        shuffle_partitions=4,
        settings={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
