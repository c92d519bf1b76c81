import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pointprep.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Lower the row threshold so that small groups take the paths for heavy ones."""

    def lower(rows):
        spark.conf.set("pointprep.hotRows", str(rows))

    yield lower
    spark.conf.unset("pointprep.hotRows")
