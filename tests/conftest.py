import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from epochlens.session import build_session

    session = build_session("local[4]", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
