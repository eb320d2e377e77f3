"""Test modules are imported by their bare names, so no two may share one."""

from __future__ import annotations

import os
from collections import Counter

HERE = os.path.dirname(os.path.abspath(__file__))


def test_module_names_are_unique():
    names = Counter(f for _, _, files in os.walk(HERE) for f in files if f.startswith("test_") and f.endswith(".py"))
    assert [n for n, k in names.items() if k > 1] == []
