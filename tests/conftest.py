import pytest

from repolens.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
