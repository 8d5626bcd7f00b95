"""SQL surface: inlined temporary functions and a periodogram table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


# bodies are plain expressions, so the optimizer inlines them
FUNCTIONS = {
    "phase_days(t DOUBLE, p DOUBLE, t0 DOUBLE)": "pmod(t - t0 + p / 2, p) - p / 2",
    "orbital_phase(t DOUBLE, p DOUBLE, t0 DOUBLE)": "(pmod(t - t0 + p / 2, p) - p / 2) / p",
    "phase_minutes(t DOUBLE, p DOUBLE, t0 DOUBLE)": "(pmod(t - t0 + p / 2, p) - p / 2) * 1440",
    "event_number(t DOUBLE, p DOUBLE, t0 DOUBLE)": "CAST(rint((t - t0) / p) AS BIGINT)",
    "circular_distance(a DOUBLE, c DOUBLE)": "abs(pmod(a - c + 0.5D, 1.0D) - 0.5D)",
    "roche_period_d(rho DOUBLE)": "12.6D / 24.0D * sqrt(1.33D / rho)",
    "count_rate(tmag DOUBLE)": "1.5e4D * pow(10.0D, (10.0D - tmag) / 2.5D)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions and the table function; returns their names."""
    names = []
    for head, body in FUNCTIONS.items():
        kind = "BIGINT" if head.startswith("event_number") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        names.append(head.split("(")[0])
    spark.udtf.register("box_periodogram", BoxPeriodogram)
    return [*names, "box_periodogram"]


def trial_frequencies(p_max: float, p_min: float, baseline: float, box: float) -> np.ndarray:
    """Ascending frequencies from 1/p_max to 1/p_min with steps of at most box / (2 * period * baseline), all in days."""
    n = 2 + int(np.log(p_max / p_min) / np.log1p(0.5 * box / baseline))
    return np.geomspace(1 / p_max, 1 / p_min, n)


@udtf(returnType="tic bigint, aperture string, period_d double, power double, depth double, duration_min double, t0 double")
class BoxPeriodogram:
    """SELECT * FROM box_periodogram(TABLE(curves) PARTITION BY (tic, aperture)) over columns tic, aperture, time, y.

    One partition is one curve. Its trial frequencies are so close that over the baseline neighbours drift by half the shortest box at
    most, whatever the period; their number follows from the baseline. Jobs over very large curves use the binned plan of the search module.
    """

    def __init__(self):
        self.t: list[float] = []
        self.y: list[float] = []
        self.key = None

    def eval(self, row):
        self.key = (row["tic"], row["aperture"])
        if row["time"] is not None and row["y"] is not None:
            self.t.append(row["time"])
            self.y.append(row["y"])

    def terminate(self) -> Iterator[tuple]:
        from lumensift.operators.search import SearchConfig, _fold_chunk
        cfg = SearchConfig()
        w, boxes = cfg.widths()
        if len(self.t) < 2:
            return
        order = np.argsort(self.t)
        t = np.asarray(self.t)[order]
        yq = np.rint((np.asarray(self.y)[order] - 1) * 1e9).astype(np.int64)
        p_max = min(cfg.max_period_fraction * (t[-1] - t[0]), cfg.p_max_cap_d)
        if p_max <= cfg.p_min_d:
            return
        f = trial_frequencies(p_max, cfg.p_min_d, t[-1] - t[0], w)
        for lo in range(0, f.size, 64):
            p = 1.0 / f[lo:lo + 64]
            power, _, o = _fold_chunk(t - t[0], yq, p, w, boxes, t.size, int(yq.sum()))
            for i in np.nonzero(power > 0)[0]:
                yield (*self.key, float(p[i]), float(power[i]), float(o["depth"][i]), float(o["dur"][i]), float(t[0] + o["t0"][i]))
