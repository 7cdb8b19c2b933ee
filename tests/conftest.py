import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from genoloom.session import local_session

    session = local_session(8, "tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
