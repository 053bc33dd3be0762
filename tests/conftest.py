import pytest

from quern.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("checkpoints")
    s = session("tests", "local[4]", **{"spark.checkpoint.dir": f"file://{scratch}", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows():
    """Sorted rows as tuples; None sorts first."""

    def of(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))

    return of
