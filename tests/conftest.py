import pytest

from tessella.session import build


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = build("tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
