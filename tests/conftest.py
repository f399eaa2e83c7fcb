import os
import sys

import pytest

_TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(_TESTS), _TESTS]
# functions that tests hand to Spark are looked up by module name in the workers
os.environ["PYTHONPATH"] = os.pathsep.join([_TESTS, os.environ.get("PYTHONPATH", "")])

from taskweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "taskweave-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
