import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelstats.session import get_session
    s = get_session(app="panelstats-tests", master="local[4]", shuffle_partitions=8)
    for name, value in {"trees": 6, "search.trees": 2, "multiclass.rounds": 2, "multiclass.depth": 3}.items():
        s.conf.set(f"panelstats.budget.{name}", str(value))
    yield s
