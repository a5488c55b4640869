import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def masks(spark):
    """Rasters (name -> rows of '#' and '.') to a run table."""
    from maskwright.operators.runs import cells_to_runs

    def build(rasters):
        rows = [
            (name, len(r), len(r[0]), y, x)
            for name, r in rasters.items() for y, line in enumerate(r) for x, c in enumerate(line) if c == "#"
        ]
        cells = spark.createDataFrame(rows, "mask_id string, h int, w int, y int, x int")
        dims = spark.createDataFrame([(n, len(r), len(r[0])) for n, r in rasters.items()], "mask_id string, h int, w int")
        return dims, cells_to_runs(cells)

    return build
