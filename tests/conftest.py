import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from glintframe import build_session

    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Pixel table of one 2-D array (or several, as ``frame=number``)."""
    import numpy as np

    def make(value, name="v", number=1, **more):
        value = np.asarray(value)
        h, w = value.shape
        rows = [(1, number, y, x, h, w, value[y, x].item(), *[np.asarray(m)[y, x].item() for m in more.values()]) for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, ["scene", "frame", "y", "x", "h", "w", name, *more])

    return make
