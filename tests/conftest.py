import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark(master="local[4]", shuffle_partitions=4)
