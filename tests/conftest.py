import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """Turns a matrix into (row_id, embedding)."""
    def make(matrix, **columns):
        rows = [(i, [float(x) for x in v], *[c[i].item() if isinstance(c, np.ndarray) else c[i] for c in columns.values()]) for i, v in enumerate(matrix)]
        extra = "".join(f", {name} int" for name in columns)
        return spark.createDataFrame(rows, f"row_id long, embedding array<double>{extra}")
    return make
