from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tidegraph.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_scratch(s)
    s.stop()
