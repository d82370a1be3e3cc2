import tempfile

import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """The session with a checkpoint folder, as on a cluster."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="molfold-tests-"))
    return spark
