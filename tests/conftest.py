import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from paths import TINY  # noqa: E402
from riskframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("riskframe-tests", cores="8")


@pytest.fixture(scope="session")
def tiny(spark):
    from riskframe.plans import warehouse
    return warehouse.tables(spark, TINY)
