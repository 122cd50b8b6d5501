"""Vectors in double precision."""

import numpy as np
from test_copies import brute_links

from basketlab.llm.metric_join import near_duplicates


def test_doubles_decide_in_double_precision(spark):
    rows = []
    for i in range(20):  # pairs of their own planes, a little above and below 0.9
        c = 0.9 + (i % 2 * 2 - 1) * (i + 1) * 1e-10
        for y in ((1.0, 0.0), (c, np.sqrt(1 - c * c))):
            x = np.zeros(44)
            x[2 * i : 2 * i + 2] = np.array(y) * (0.3 + i)
            rows.append(x)
    rows += [np.eye(44)[42] * 1e200, np.eye(44)[42] * 2e200, np.eye(44)[43] * 1e-200, np.eye(44)[43] * 3e-200]
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "id long, v array<double>")
    got = sorted((r.id, r.n_links, r.component_id, r.id == r.component_id) for r in near_duplicates(frame, "id", "v").collect())
    unit = np.array([x / np.abs(x).max() for x in rows])
    assert got == brute_links(list(range(44)), unit, np.ones(44, dtype=bool))
