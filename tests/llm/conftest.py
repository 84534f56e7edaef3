import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import frame, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
