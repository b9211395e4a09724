from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from papyra.session import build_session

    s = build_session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
