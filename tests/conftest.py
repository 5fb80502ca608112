import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plantspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, partitions=4, app="plantspark-tests")


@pytest.fixture(scope="session")
def readings(spark):
    from plantspark.plans.inputs import readings

    return readings(spark, SMALL).cache()


@pytest.fixture(scope="session")
def frame(readings):
    """The same readings in pandas, in series order."""
    return readings.toPandas().sort_values(["plant", "unit", "tag", "time"]).reset_index(drop=True)


@pytest.fixture(params=["whole", "cut"])
def layout(request, monkeypatch):
    """Run a test with whole series and with every series cut into small pieces."""
    from plantspark.operators import sequence

    if request.param == "cut":
        monkeypatch.setattr(sequence, "TARGET_ROWS", 8)
        monkeypatch.setattr(sequence, "BLOCK_CUTS", 2)
    return request.param
