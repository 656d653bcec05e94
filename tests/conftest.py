"""One session for all tests; its shared folder is a temporary one."""

import tempfile

import pytest

from tallyloom.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": f"{folder}/warehouse",
        "spark.checkpoint.dir": f"file://{folder}/shared",
        "spark.ui.showConsoleProgress": "false",
    }
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
