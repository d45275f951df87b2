from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    os.environ.setdefault("CORPUSLOOM_TMP", tempfile.mkdtemp(prefix="corpusloom-test-"))
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
