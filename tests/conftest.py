import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanguard.schema import CATEGORY_OF, FINDING  # noqa: E402
from spanguard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def make_finding(entity_type="EMAIL", start=0, end=5, confidence=0.95, detector="regex", text="x"):
    values = (entity_type, CATEGORY_OF[entity_type], start, end, text, confidence, detector)
    return dict(zip(FINDING.fieldNames(), values))


@pytest.fixture(scope="session")
def finding():
    return make_finding
