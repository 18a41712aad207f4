import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from evidlake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.log.level": "ERROR", "spark.driver.memory": "8g",
            # A tiny limit, so that every skew-spreading join really spreads keys.
            "spark.evidlake.hotKeyRows": "5",
        },
    )
    yield session
    session.stop()
