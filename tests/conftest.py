import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from talus.session import session

    s = session("tests", "local[8]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def executed(spark):
    """Runs a function of Spark jobs and returns the trees of the plans that it ended with, stored steps among them."""

    def run(work):
        bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
        bus.waitUntilEmpty()
        known = store.executionsCount()
        work()
        bus.waitUntilEmpty()
        every = store.executionsList()
        texts = [every.apply(i).physicalPlanDescription() for i in range(known, every.size())]
        return [t.split("+- == Initial Plan ==")[0].split("\n\n")[0] for t in texts]

    return run
