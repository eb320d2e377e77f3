from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tracewright.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return tune(local_session(checkpoint_dir=tempfile.mkdtemp(prefix="tracewright-")))
