import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return compare.session()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("BATCHWATCH_TEST_DIR", "/root/testdata/sf0.001")
