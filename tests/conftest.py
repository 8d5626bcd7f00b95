import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumensift.session import build_session


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.local.dir": tmp, "spark.sql.warehouse.dir": tmp + "/wh", "spark.checkpoint.dir": tmp + "/ck"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def planted():
    """Nine days at five minutes, a 20-minute box of depth 0.2 every 1.5 days, a weak sine, two apertures, two orbits."""
    t = np.arange(0, 9, 5 / 1440)
    rng = np.random.default_rng(1)
    y = 1 + 2e-4 * np.sin(2 * np.pi * t / 0.37) + rng.normal(0, 1e-4, t.size)
    y[np.abs((t - 0.2 + 0.75) % 1.5 - 0.75) <= 10 / 1440] -= 0.2
    parts = [pd.DataFrame({"sector": 1, "tic": 7, "aperture": a, "cadenceno": np.arange(t.size), "time": t, "orbitid": (t > 4.5).astype(int), "quality": 0, "flux": y}) for a in ("SML", "PRI")]
    return pd.concat(parts, ignore_index=True)
