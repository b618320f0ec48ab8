from __future__ import annotations

import logging
import sys
from pathlib import Path

import pytest

logging.getLogger("DataFrameQueryContextLogger").disabled = True
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import local_session

    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
