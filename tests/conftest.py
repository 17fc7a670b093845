import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import session  # noqa: E402

from docflow.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return configure(session(os.environ.get("TEST_CPUS", "8")))


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
