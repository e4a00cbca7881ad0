import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scenegrain.session import local_session

    s = local_session("4", partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
